"""Quotation linking on random threads against plain Python, with a hot passage, and its order."""

import random
import re

from millrace.llm.chat_quotes import link_quotes

SCHEMA = "conv_id long, turn long, role string, text string, rid string, h int, n int"  # clashing names too


def norm(t):
    return re.sub(r"[\s\xa0]+", " ", t.lower()).strip(" ")


def brute(rows):
    parsed = []
    for conv, turn, role, text in rows:
        text = text or ""
        quotes = any(re.match(r" {0,3}>", x) for x in text.split("\n"))
        if not quotes:
            parsed.append((conv, turn, text, []))
            continue
        lines = []
        for x in text.split("\n"):
            p = re.match(r"((?: {0,3}>)+ ?)", x)
            p = p[1] if p else ""
            lines.append((p.count(">"), x[len(p) :]))
        runs, own = [], []
        for i, (level, words) in enumerate(lines):
            if i == 0 or lines[i - 1][0] != level:
                runs.append([level, []])
            runs[-1][1].append(words)
            ahead = lines[i + 1][0] if i + 1 < len(lines) else 0
            if level == 0 and not (ahead > 0 and re.match(r"On .{1,200} wrote: *$", words)):
                own.append(words)
        parsed.append((conv, turn, "\n".join(own).strip(" \n"), [(i, level, "\n".join(w)) for i, (level, w) in enumerate(runs, 1) if level]))
    holds = {}
    for conv, turn, body, _ in parsed:
        if conv is not None and turn is not None:
            for u in {norm(body), *map(norm, body.split("\n"))} - {""}:
                holds.setdefault(u, {}).setdefault(conv, []).append(turn)
    found, up = [], {}
    for conv, turn, body, quotes in parsed:
        hits = []
        if conv is not None and turn is not None:
            for run, level, words in quotes:
                for part, u in [(0, norm(words)), *((1, norm(x)) for x in words.split("\n"))]:
                    at = holds.get(u, {}) if u else {}
                    before = min(at[conv]) if conv in at else None
                    others = sorted(c for c in at if c != conv)
                    if before is not None and before < turn:
                        hits.append((level, run, part, 0, conv, before))
                    elif others:
                        hits.append((level, run, part, 1, others[0], min(at[others[0]])))
        best = min(hits) if hits else None
        if best and best[4] == conv and best[5] < turn:
            up[conv, turn] = min(best[5], up.get((conv, turn), best[5]))
        found.append([conv, turn, body, len(quotes), max((q[1] for q in quotes), default=0), len({h[1] for h in hits}), best and best[4], best and best[5]])
    for f in found:
        top = f[1]
        while (f[0], top) in up:
            top = up[f[0], top]
        f.append(top)
    return found


def threads(seed, convs=12):
    r = random.Random(seed)
    words = "red blue green tea cake rain sun road hill sea".split()
    line = lambda: " ".join(r.choices(words, k=r.randint(1, 4)))
    rows, said = [], ["The hot passage\nof two lines"]
    for c in range(convs):
        for t in range(r.randint(1, 9)):
            parts = []
            for _ in range(r.randint(0, 3)):
                kind = r.random()
                if kind < 0.5:
                    quoted = r.choice(said)
                    level = r.randint(1, 3)
                    parts.append("\n".join([*(["On Monday A wrote:"] if r.random() < 0.3 else []), *(r.choice(("> ", ">", "  > ")) * level + x.upper() for x in quoted.split("\n"))]))
                else:
                    parts.append("\n".join(line() for _ in range(r.randint(1, 3))))
                    said.append(parts[-1])
            rows.append((c if r.random() > 0.03 else None, t if r.random() > 0.03 else None, r.choice(("user", "assistant", None)), "\n".join(parts) or r.choice(("", None))))
    return rows + rows[:3]


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in (x[0], x[8], x[1]))


def test_random_threads(spark):
    for seed in range(3):
        rows = threads(seed)
        d = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
        got = link_quotes(spark, d).collect()
        as_rows = [[r["conv_id"], r["turn"], r["body"], r["n_quotes"], r["max_level"], r["n_linked"], r["parent_conv"], r["parent_turn"], r["thread_turn"]] for r in got]
        want = brute(rows)
        assert sorted(map(repr, as_rows)) == sorted(map(repr, want))
        assert sum(w[5] > 0 for w in want) > 10
        assert [key(r) for r in as_rows] == sorted(key(r) for r in as_rows)
        assert [r["order_key"] for r in got] == sorted(r["order_key"] for r in got)
        assert all(r["formatted"] == f"<|im_start|>{r['role'] or ''}\n{r['body']}<|im_end|>\n" for r in got)


def test_hot_passage_and_one_long_conversation(spark):
    """A third of all messages quote the same passage; a conversation of many turns answers its first one, and a chain goes through all of another."""
    rows = [(0, 0, "user", "the hot passage")] + [(0, t, "user", "> The hot  passage\nyes") for t in range(1, 400)] + [(c, 0, "user", "> the hot passage") for c in range(1, 400)]
    rows += [(1000, t, "user", f"> line {t - 1}\nline {t}") for t in range(200)]
    got = link_quotes(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    of = {(r["conv_id"], r["turn"]): r for r in got}
    assert len(got) == len(rows) and all((of[0, t]["parent_conv"], of[0, t]["parent_turn"], of[0, t]["thread_turn"], of[0, t]["body"]) == (0, 0, 0, "yes") for t in range(1, 400))
    assert all((of[c, 0]["parent_conv"], of[c, 0]["parent_turn"], of[c, 0]["n_linked"]) == (0, 0, 1) for c in range(1, 400))
    assert all(of[1000, t]["thread_turn"] == 0 and of[1000, t]["parent_turn"] == t - 1 for t in range(1, 200))


def test_no_messages_and_no_quotes(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert link_quotes(spark, spark.createDataFrame([], schema)).collect() == []
    got = link_quotes(spark, spark.createDataFrame([(1, 0, "u", "a > b"), (None, None, None, None)], schema)).collect()
    assert [(r["conv_id"], r["body"], r["n_quotes"], r["order_key"]) for r in got][0][:3] == (None, "", 0) and got[1]["body"] == "a > b"
