r"""Chat formatting by quotation linking, with DataFrame functions only.

A line quotes at the level of the ``>`` signs it starts with (up to three blanks before each,
one behind the last). Runs of lines of one level are passages. A passage and, where it has
several lines, each of them are normalised (lower case, white space collapsed, outer blanks
cut), hashed, and joined to the hashes of the messages' own words: whole bodies and their
lines. Each hash has one original: the earliest turn of the same conversation before the
quoting one, else the first message of another conversation by (conv_id, turn).

``body`` is a message without its quotes, and without an attribution line ("On ... wrote:") in
front of one. A message answers the original of its first linked passage, of the lowest level
first. Threads are found by pointer jumping over the links within conversations. Messages come
ordered by conversation, thread (its first turn) and turn, so that each reply follows what it
answers; ``order_key`` sorts as they do, so that the order outlives a write or a join.
``formatted`` is a message in chat markup, to be joined in that order.

Nothing gathers a conversation, a passage or a thread in a task: originals come from partial
aggregates of (hash, conversation), keys with many rows meet a bounded broadcast, the order is
a range sort.

Defined cases: a null text is empty, quotes nothing and is no original (nor is any blank
body); null conv_id and turn are ordered first and are not linked; a null role is empty in
``formatted``; of repeated rows each is returned; rows that share conversation and turn share
their thread; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, join_by_weight, table

QUOTED = r"(?m)^ {0,3}>"
PREFIX = r"^((?: {0,3}>)+ ?)"
WROTE = r"^On .{1,200} wrote: *$"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{a0}]+", " "))


def _hash(text: Column) -> Column:
    """The first half of the SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _parts(text: Column) -> Column:
    """(part, n) of a whole text and of its lines, normalised, without blank ones."""
    pair = lambda k, x: F.struct(F.lit(k).alias("part"), normal(x).alias("n"))
    return F.filter(F.array_distinct(F.concat(F.array(pair(0, text)), F.transform(F.split(text, "\n"), lambda x: pair(1, x)))), lambda p: p["n"] != "")


def parse(ws: Workspace, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts: a row a message with its body; passages: a row a quoted run of lines)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = ws.write(messages.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("t"), text.rlike(QUOTED).alias("quotes"), F.monotonically_increasing_id().alias("rid")), "messages")
    line = rows.filter("quotes").select("rid", "conv", "turn", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    prefix = F.regexp_extract("line", PREFIX, 1)
    line = line.withColumn("level", F.char_length(F.regexp_replace(prefix, "[^>]", ""))).withColumn("words", F.substr("line", F.char_length(prefix) + 1))
    by_row = Window.partitionBy("rid").orderBy("pos")  # the lines of one message
    line = line.withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(by_row)).cast("int")).withColumn("next", F.lead("level", 1, 0).over(by_row))
    line = ws.write(line.withColumn("run", F.sum("new").over(by_row)), "lines")
    own = line.filter((F.col("level") == 0) & ~((F.col("next") > 0) & F.col("words").rlike(WROTE)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"]), "\n")
    bodies = own.groupBy("rid").agg(F.trim(joined, F.lit(" \n")).alias("body"))
    passages = ws.write(line.filter("level > 0").groupBy("rid", "conv", "turn", "run", "level").agg(joined.alias("words")), "passages")
    quoting = rows.filter("quotes").join(bodies, "rid", "left").withColumn("body", F.coalesce("body", F.lit("")))
    plain = rows.filter("not quotes").withColumn("body", F.col("t"))
    columns = ["rid", "conv", "turn", "role", "body"]
    texts = ws.write(quoting.select(*columns).unionByName(plain.select(*columns)), "bodies")
    for step in ("messages", "lines"):  # nothing reads them any more
        ws.drop(step)
    return texts, passages


def originals(ws: Workspace, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, conv, near_turn, o, o2, uses): for each hash that a conversation quotes, its first turn there and the first two conversations with it.

    Own lines and quoted hashes meet in one aggregate by (h, conv), which map tasks combine, so a line that a
    third of all messages hold is no hot key.
    """
    units = texts.filter("conv is not null and turn is not null").select("conv", "turn", F.explode(_parts(F.col("body"))).alias("p"))
    units = units.select(_hash(F.col("p.n")).alias("h"), "conv", "turn", F.lit(0).cast("long").alias("use"))
    quoted = wanted.select("h", "conv", F.lit(None).cast("long").alias("turn"), F.lit(1).cast("long").alias("use"))
    here = ws.write(units.unionByName(quoted).groupBy("h", "conv").agg(F.min("turn").alias("turn"), F.sum("use").alias("uses")), "originals")
    # the two smallest conversations of a hash: ranks prune in the map tasks, which pass on two rows a hash at most
    ranked = here.filter("turn is not null").select("h", "conv", "turn", F.row_number().over(Window.partitionBy("h").orderBy("conv")).alias("k")).filter("k <= 2")
    of = lambda k: F.min(F.when(F.col("k") == k, F.struct("conv", "turn")))
    far = ranked.groupBy("h").agg(of(1).alias("o"), of(2).alias("o2"))
    pairs = here.filter("uses > 0").select("h", "conv", F.col("turn").alias("near_turn"), "uses")
    hashes = ws.write(pairs.groupBy("h").agg(F.count(F.lit(1)).alias("convs")).join(far, "h", "left"), "hashes")
    return ws.write(join_by_weight(pairs, hashes, ["h"], "convs", pairs.count()), "origins")


def link_quotes(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quotes, max_level, n_linked, parent_conv, parent_turn, thread_turn, order_key, formatted."""
    ws = Workspace(spark, "quotes")
    texts, passages = parse(ws, messages)
    wanted = passages.filter("conv is not null and turn is not null").select("rid", "conv", "turn", "run", "level", F.explode(_parts(F.col("words"))).alias("p"))
    wanted = ws.write(wanted.select("rid", "conv", "turn", "run", "level", "p.part", _hash(F.col("p.n")).alias("h")), "wanted")
    origins = originals(ws, texts, wanted)
    hit = join_by_weight(wanted, origins, ["h", "conv"], "uses", wanted.count())
    far = F.when(F.col("o.conv") != F.col("conv"), F.col("o")).otherwise(F.col("o2"))
    local = F.col("near_turn") < F.col("turn")
    origin = F.when(local, F.struct(F.lit(0).alias("far"), F.col("conv").alias("conv"), F.col("near_turn").alias("turn"))).when(far.isNotNull(), F.struct(F.lit(1).alias("far"), far["conv"].alias("conv"), far["turn"].alias("turn")))
    best = hit.select("rid", "run", "level", "part", origin.alias("o")).filter("o is not null").groupBy("rid").agg(F.min(F.struct("level", "run", "part", "o")).alias("b"), F.count_distinct("run").alias("n_linked"))
    seen = passages.groupBy("rid").agg(F.count(F.lit(1)).alias("n_quotes"), F.max("level").cast("long").alias("max_level"))
    found = texts.join(seen.join(best, "rid", "left"), "rid", "left").select("rid", "conv", "turn", "role", "body", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_quotes", "max_level", "n_linked")), F.col("b.o.conv").alias("parent_conv"), F.col("b.o.turn").alias("parent_turn"))
    found = ws.write(found, "found")
    for step in ("bodies", "passages", "wanted", "originals", "hashes", "origins"):
        ws.drop(step)
    roots = _roots(ws, found.filter("parent_conv = conv and parent_turn < turn").groupBy("conv", "turn").agg(F.min("parent_turn").alias("up")))
    rooted = found.filter("conv is not null and turn is not null").join(roots, ["conv", "turn"], "left").withColumn("thread_turn", F.coalesce("up", "turn")).drop("up")
    loose = found.filter("conv is null or turn is null").withColumn("thread_turn", F.col("turn"))
    return _ordered(rooted.unionByName(loose.select(*rooted.columns)))


def _roots(ws: Workspace, links: DataFrame) -> DataFrame:
    """(conv, turn, up) with ``up`` the first turn of the thread; the way doubles each round.

    What many turns answer is looked up once and meets them by weight.
    """
    now, k = ws.write(links, "links-0"), 0
    while True:
        above = now.select("conv", F.col("turn").alias("up"), F.col("up").alias("top"))
        asked = ws.write(now.groupBy("conv", "up").agg(F.count(F.lit(1)).alias("n")).join(above, ["conv", "up"], "left"), f"asked-{k}")
        if asked.filter("top is not null").isEmpty():
            return now
        new = join_by_weight(now, asked, ["conv", "up"], "n", now.count()).select("conv", "turn", F.coalesce("top", "up").alias("up"))
        now, k = ws.write(new, f"links-{k + 1}"), k + 1


def _ordered(rows: DataFrame) -> DataFrame:
    digits = lambda c: F.coalesce(F.lpad((F.col(c).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0"), F.lit(""))
    key = F.concat_ws(" ", *map(digits, ("conv", "thread_turn", "turn")))
    formatted = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), "body", F.lit("<|im_end|>\n"))
    return rows.orderBy("conv", "thread_turn", "turn", "rid").select(F.col("conv").alias("conv_id"), "turn", "role", "body", "n_quotes", "max_level", "n_linked", "parent_conv", "parent_turn", "thread_turn", key.alias("order_key"), formatted.alias("formatted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(spark, table(spark, sf_dir, "conversations"))
