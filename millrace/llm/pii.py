"""Personal data: base patterns and a linear-chain conditional random field over word shapes.

Base spans (leftmost, non-overlapping per kind; matches that fail their test are dropped and
the search goes on behind them): email, ip, card, phone. The field adds names, street
addresses and identity numbers; its trained weights alone decide where. Base spans stay, and an added span that overlaps one
is dropped.

The field has six labels (outside; name, address, identity number: begin and inside of the
first two, the number one word), and features of the word, its shape, the list it is in (given
names, street words, titles, documents; English, German, French, Spanish) and its neighbours'.
It is trained at first use by gradient ascent on the small labelled table below, which is made by
template with seeded draws and holds no line of any scored table. Decoding is
Viterbi in numpy over batches of lines; lines where no label but outside can lie on the best
path, by a bound on all of the line's scores, are not walked.

Offsets are code points, ends exclusive. Defined cases: null or empty text has no spans;
texts are read whole whatever their length; documents that repeat are each reported; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table

# Fixed values of the base contract: character sets and patterns.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")


def _emails(text: str) -> list[tuple[int, int]]:
    """A match starts where the run before an @ does, but not before the last match or @."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        run = text[low:at]
        start = low + len(run.rstrip(LOCAL))
        low = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", low)
    return out


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out["phone"].append(m.span())
    return out


#: Words whose lines are decoded together, and the words of a table of best paths, padding included.
WORDS, CELLS = 100_000, 400_000
#: What a word outside gains when decoding, in nats: text holds far less personal data than the labelled table.
CAUTION = 0.5
LABELS = ("O", "B-name", "I-name", "B-address", "I-address", "id")
_BEGIN, _INSIDE = {1: "name", 3: "address", 5: "id"}, {2: "name", 4: "address"}
#: Words whose identity is a feature; the others count by their shape alone. Fixed values.
CUES = ("my", "name", "is", "mr", "mrs", "ms", "dr", "prof", "dear", "sincerely", "regards", "signed", "contact", "patient", "street", "st", "avenue", "ave", "road", "rd", "lane", "drive", "boulevard", "square", "ssn", "passport", "no", "number", "id", "lives", "at", "born", "the", "of", "and", "in", "on", "to", "for", "was", "de", "la", "du")


#: Lists whose membership is a feature, beside CUES. Fixed values.
LISTS = {
    "given": "anna john maria wei fatima pierre ivan sara tom lena peter paul mary james robert michael david william richard joseph thomas charles daniel matthew anthony mark andrew steven george kevin brian edward jane susan linda emma olivia sophia alice laura julia sarah karen nancy lisa helen emily hans karl klaus jürgen wolfgang stefan andreas markus heinz ursula sabine petra monika heike claudia katrin jean jacques michel philippe françois louis luc marc marie claire sophie camille isabelle nathalie élodie juan josé carlos luis miguel antonio manuel javier pablo diego carmen isabel ana lucía elena rosa ahmed mohammed ali omar aisha yuki hiroshi kenji raj priya amit olga natalia dmitri sergei giulia marco luca giovanni",
    "street": "street st avenue ave road rd lane drive boulevard square court rue place chemin quai allée calle avenida plaza paseo camino straße strasse weg platz allee gasse",
    "title": "mr mrs ms miss dr prof sir herr frau monsieur madame mme mademoiselle señor señora sr sra don doña dear sincerely regards signed contact patient",
    "paper": "ssn passport passeport reisepass pasaporte ausweis personalausweis dni nie identity insurance licence license",
    "called": "called wrote said met lives am bin heiße heisse suis appelle llamo soy by von par por from with",
}
_LIST = {w: k for k, ws in LISTS.items() for w in ws.split()}
_WIDTH = 5  # features of a word


def shape(word: str) -> str:
    """Runs of upper, lower, digit, other; digit runs keep their length up to five."""
    if word.isalpha():
        if word.islower():
            return "x"
        if word[0].isupper() and word[1:].islower():
            return "Xx"
    out = []
    for ch in word[:64]:
        c = "X" if ch.isupper() else "x" if ch.isalpha() else "d" if ch.isdigit() else ch if ch in ".,-:/@'" else "#"
        if c == "d" or not out or out[-1] != c:
            out.append(c)
    return re.sub("d{6,}", "D", "".join(out))


def _bare(word: str) -> str:
    return word.strip(".,:;!?()\"'").lower()


def features(word: str) -> tuple[str, ...]:
    b = _bare(word)
    kind = _LIST.get(b) or ("street" if b.endswith(("straße", "strasse", "gasse", "platz", "weg", "allee", "ring")) else "-")
    form, end = shape(word.rstrip(".,:;!?") or word), word[-1] if word[-1] in ".,:;!?" else "-"
    return ("g=" + kind, "s=" + form, "w=" + b if b in CUES else "w=*", "e=" + end, "n=" + str(min(len(b), 4)))


# What the labelled table is made of. None of it comes from a scored table.
_FAMILY = "Keller Smith Garcia Novak Dubois Petrov Meyer Baker O'Neil Lopez Meyer-Koch Müller Rossi Tanaka Khan McDonald Schmidt Moreau Jensen Kowalski Fernández Ivanova Silva Okafor Nguyen Haddad Brown Wagner Lefèvre Castillo Horváth Popescu".split()
_RARE = "Zelda Torsten Imogen Bartek Solveig Ximena Aurelio Gudrun Thibault Noor Kwame Ingrid Casimir Leocadia Rurik Odile".split()
_STREETS = {
    "en": "{n} {F} Street|{n} North {F} Road|{n} Old {W} Lane|{n} {W} Avenue|{n} {W} Crescent|{n} St. {G} Square|{n} {F} Drive|{n} {W} Hill|{n} {W} Court",
    "de": "{W}straße {n}|{W}weg {n}|Am {W}platz {n}|{F}gasse {n}|{F}-Allee {n}|Alte {W}straße {n}|{W}ring {n}",
    "fr": "{n} Rue {F}|{n} rue de {W}|{n} Avenue du {W}|{n} Boulevard {G} {F}|{n} Place de la {W}|{n} chemin des {W}|{n} Quai {F}",
    "es": "Calle {W} {n}|Calle de {F} {n}|Avenida {F} {n}|Plaza del {W} {n}|Paseo de la {W} {n}|Camino {W} {n}",
}
_WORDS = {"en": "Oak Maple Mill King Lake Church Park Willow Station Harbour", "de": "Linden Garten Bahnhof Schul Berg Haupt Wiesen Kirch Rosen Mühlen", "fr": "Lyon Rivoli Gare Fleurs Moulin Écoles République Vignes", "es": "Mayor Sol Luna Iglesia Rosa Estación Olmo Fuente"}
_LINES = {
    "en": "{N} called from the office|{N} wrote the letter and left.|The form was signed by {N} in May|I am {N} and this is my order|I am {N}.|My name is {N}.|my name is {N} and the work was done|{N} lives at {A} in the town|met with {N} on Monday|I met {N} last week|She talked to {N} about the plan|a letter from {N}, who was away|{N} said that the work is done|Mr. {F} was in the hall|We met Dr. {F}, and then the others|Dear Mrs. {N}, the order is on its way|Dear {N},|Best regards, {N}|Thanks, {N}|Yours, {N}|Sincerely, {N}|Regards {N}|{N}, {A}|contact {N} at the desk|Contact: {N}|The patient {N} was in bed|the customer, {N}, asked for it|according to {N} it was late|The report of {N} is here|written by {N}|author: {N}|{N} and {N} were there|between {N} and {N}|our colleague {N} is back|with {N}|for {N}|Prof. {N} gave a talk|The house at {A} is old|Visit us at {A}, please|sent to {A} for repair|Address: {A}|{A}|Ship to: {A}|She moved to {A} in June|he lives at {A}|We met at {A} for lunch|passport number {I} was lost|Her passport number is {I} and|Passport {I}|Passport: {I}|Passport no. {I}|his passport is {I}|Her SSN is {I}|The SSN {I} was on the form.|SSN: {I}|insurance number {I},|identity card {I}|license number {I} expired|My ID is {I}|ID number {I}|The ID card {I} is valid",
    "de": "Herr {F} ist da|Frau {F} hat die Rechnung|Herr {N} wohnt in der {A}|Ich heiße {N} und bin hier|Mein Name ist {N}.|ich bin {N}|Sehr geehrte Frau {F},|Lieber Herr {F},|Liebe {G},|mit {N} am Montag|ein Brief von {N} aus Bonn|{N} sagte, dass es regnet|unterschrieben von {N}|Viele Grüße {N}|Mit freundlichen Grüßen {N}|Dr. {N} ist im Haus|Wir wohnen in der {A} seit Mai|Adresse: {A}|Die Wohnung in der {A} ist frei|Das Büro liegt {A}|Mein Reisepass {I} ist weg|Reisepass Nr. {I} ist gültig|Personalausweis {I}|Ausweisnummer {I}|die Kundin {N} rief an",
    "fr": "Monsieur {F} est ici|Madame {N} habite {A}|Mme {F} a payé|Je suis {N}|Je m'appelle {N}.|Cordialement, {N}|Chère {N},|Cher Monsieur {F},|Bonjour {N},|une lettre de {N} est là|avec {N} lundi|signé par {N}|{N} a dit que le travail est fini|Il habite au {A} à Paris|Elle habite {A}|Adresse : {A}|Le bureau du {A} est fermé|Numéro de passeport {I}|son passeport {I} est perdu|la patiente {N} est partie|carte d'identité {I}",
    "es": "Señor {F} vive en {A}|La señora {N} llamó a las dos|El señor {F} pagó|Me llamo {N} y soy de aquí|Soy {N}.|Mi nombre es {N}.|Estimado {N}:|Estimada señora {F},|Saludos, {N}|una carta de {N} llegó|con {N} el lunes|firmado por {N}|{N} dijo que no|Vive en la {A} de Madrid|Dirección: {A}|La oficina de la {A} está cerrada|DNI {I} de España|su DNI es {I}|pasaporte {I}|Número de pasaporte {I}|el paciente {N} se fue",
}
_PLAIN = """The order number 123456789 was sent|order number 550123987|The number is 123456789 and|phone number 987654321 is busy|Part AB123456C of the engine|item X1234567 in box 98-7654321|Call 550123987 or 123456789 now|version 3 license 2 passport of the|Order AB-1234 from the list|invoice 12-34-5678 of May|The code X7654321 opens the box|Serial number L898902C3|room 12, floor 3|Chapter 12 Old Roads of Europe|Section 4 The Road Ahead
Red Cross and the World Bank met in New York|Getting Started With Machine Learning In Practice|Berlin Paris London Madrid|United States of America|The Main Street was closed|From Monday to Friday by Train|by Car and from Here with Love|Title Case Heading About Nothing|In the Road to Rome 5 Kings met|Rue is a word and Street too|12 Apples 7 Pears 3 Plums|at 10 Monday May 4 in Paris|I am here and I am glad|I am Sorry About That|mark the bill and paul it by will
In 1999 the King of Spain and the Duke of York met in Paris on May 4 at 10 to talk.|The name of the street is not known. The Name is what the Road to Rome was for.|Of the 12 Red Apples and 7 Green Pears in the box no 3 was good.|Dear all, regards to the team. Contact the office. Signed and sealed.|Thanks, everyone|Best regards, the Team|Dear Customer,|Dear Sir or Madam,|Visit us at the Fair, please|written by hand|signed by both sides|with Pleasure|for Example|according to Plan
Die Straße ist lang und der Platz ist leer|Im Jahr 1999 war der Weg nach Rom 12 Tage lang|Herr der Ringe|Frau und Mann|Sehr geehrte Damen und Herren,|Mit freundlichen Grüßen|Der Name ist Programm.|Mein Haus ist klein und der Garten groß|Die Große Koalition und der Deutsche Bundestag|ein Brief von gestern|unterschrieben von beiden
La rue est longue et la place est vide|Madame, Monsieur,|Je suis ici depuis lundi|Bonjour à tous,|La Tour Eiffel et le Mont Blanc|avec Plaisir|L'Union Européenne a dit non|Une place de parking est libre
La calle es larga y el camino también|Soy de aquí.|Estimados clientes:|Con mucho gusto|El Río de la Plata|Mi nombre no importa|Estados Unidos de América|La plaza está vacía
the insurance was paid in 2004 and the license in 2005|Licensed under the Open Licence, Version 2.0.|This Work Is Shared Under The Terms Below|token = \"9f8e7d6c5b4a39281706\" and the rest|GREAT OFFER!! BUY NOW!! LAST CHANCE!!|alpha | beta | Gamma | delta | Epsilon ||lorem### ipsum*** Dolor&&& sit%%% Amet$$$|Win + Save * Now Or Never|+1 (017) 555-0100 or 10.0.0.1 at 4111111111111111 in 2024-05-17|12-34-5678 and 99-99-9999|Peace. Love. Unity.|Yes. No. Maybe. Never.|Red, Green, Blue, Yellow""".replace("\n", "|").split("|")


def _syllables(r: random.Random, most: int) -> str:
    """A word of no language, made by rule."""
    return "".join(r.choice("bcdfghklmnprstvwz") * (r.random() < 0.8) + r.choice(("a", "e", "i", "o", "u", "ei", "au", "é", "ü", "ou")) + r.choice(("", "", "n", "r", "s", "nd", "ch", "ß")) for _ in range(r.randint(1, most)))


def _filled(r: random.Random, line: str, lang: str) -> list[tuple[str, int]]:
    """Words with labels; {N} a name, {F} a family name, {G} a given one, {A} an address, {I} an identity number."""
    given = LISTS["given"].split()
    first = lambda: r.choice(given).capitalize() if r.random() < 0.6 else r.choice(_RARE) if r.random() < 0.5 else _syllables(r, 3).capitalize()
    family = lambda: r.choice(_FAMILY) if r.random() < 0.5 else _syllables(r, 3).capitalize()
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def address() -> str:
        out = r.choice(_STREETS[lang].split("|"))
        return out.format(n=str(r.randint(1, 250)) + r.choice(("", "", "", "", "a", "B")), F=family(), W=r.choice(_WORDS[lang].split()) if r.random() < 0.5 else _syllables(r, 2).capitalize(), G=first())

    def paper() -> str:
        a = lambda n: "".join(r.choice("ABCDEFGHKLMNPRTXYZ") for _ in range(n))
        return r.choice((lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: a(1) + digits(7), lambda: a(2) + digits(6) + a(1), lambda: digits(8) + a(1), lambda: digits(9), lambda: a(1) + digits(2) + a(1) + digits(6), lambda: a(1) + digits(7) + a(1), lambda: a(2) + digits(7)))()

    def name() -> str:
        middle = f" {r.choice('ABCDEFGHJKLMR')}." if r.random() < 0.08 else f" {first()}" if r.random() < 0.08 else ""
        return first() + middle + (" " + r.choice(("de", "van", "von", "di")) if r.random() < 0.04 else "") + " " + family()

    out: list[tuple[str, int]] = []
    for part in re.split(r"(\{.\}\S*)", line):
        if not part.startswith("{"):
            out += [(w, 0) for w in part.split()]
            continue
        make, begin, inside = {"N": (name, 1, 2), "F": (family, 1, 2), "G": (first, 1, 2), "A": (address, 3, 4), "I": (paper, 5, 5)}[part[1]]
        words = (make() + part[3:]).split()
        out += [(w, begin if k == 0 else inside) for k, w in enumerate(words)]
    return out


def _table(copies: int = 8, prose: int = 3000) -> list[tuple[list[str], list[int]]]:
    """The labelled table, made by template with seeded draws: lines with personal data, lines that look like it, and prose by rule."""
    r, rows = random.Random(7), []
    for lang, lines in _LINES.items():
        for line in lines.split("|"):
            for _ in range(copies):
                tail = [(_syllables(r, 3), 0) for _ in range(r.randint(1, 5))] if line[-1] not in ".,:" and r.random() < 0.3 else []
                rows.append(_filled(r, line, lang) + tail)
    rows += [[(w, 0) for w in x.split()] for x in _PLAIN if x.strip() for _ in range(copies // 2)]
    small = "the of and in is at was for no my st de la und der mit von el con par à".split()
    for k in range(prose):  # sentences, words that repeat, numbers, headings, marks stuck to words
        words, capital, style = [], True, r.random()
        again = _syllables(r, 2)
        for _ in range(r.randint(2, 5) if style >= 0.9 else r.randint(2, 26)):
            w = again if style < 0.15 and r.random() < 0.8 else r.choice(small) if r.random() < 0.25 else str(r.randint(1, 3000)) if r.random() < 0.03 else _syllables(r, 4)
            w = w.upper() if 0.15 <= style < 0.2 else w.capitalize() if capital or style >= 0.9 or r.random() < 0.06 else w
            stop = r.random()
            capital = stop < 0.12
            words.append(w + ("." if stop < 0.1 else "!!" if stop < 0.12 else "," if stop < 0.2 else r.choice(("###", "***", "%%%", "|")) if 0.2 <= style < 0.25 else ""))
            if r.random() < 0.02:
                words[-1] = r.choice(("<{}>", "({})", "<|{}|>", "[{}]", "{}=", "#{}", "@{}")).format(words[-1])
        rows.append([(w, 0) for w in words])
    return [([w for w, _ in row], [t for _, t in row]) for row in rows]


class Field:
    """Weights of feature at offset -2..2 and label, and of label pairs."""

    OFFSETS = (-2, -1, 0, 1, 2)

    def __init__(self, weights: tuple[bytes, bytes] | None = None):
        self.names: dict[str, int] = {"<unseen>": 0, "<edge>": 1}
        for w in CUES:
            self.names.setdefault("w=" + w, len(self.names))
        for words, _ in _table():
            for w in words:
                for f in features(w):
                    self.names.setdefault(f, len(self.names))
        self.memo: dict[str, int] = {}
        self.rows: list[tuple[int, ...]] = [(1,) * _WIDTH]  # feature ids by word class; class 0 is the edge
        self.index: dict[tuple[int, ...], int] = {self.rows[0]: 0}
        k = len(LABELS)
        self.emit, self.pair = np.zeros((len(self.OFFSETS), len(self.names), k)), np.zeros((k, k))
        self.block = np.zeros((k, k))  # what may not follow: an inside label only goes on with its kind
        for inside, begin in ((2, 1), (4, 3)):
            self.block[[a for a in range(k) if a not in (begin, inside)], inside] = -1e4
        self.first = np.where(np.isin(np.arange(k), list(_INSIDE)), -1e4, 0.0)
        self.scores = None
        if weights:
            self.emit, self.pair = (np.frombuffer(w).reshape(x.shape) for w, x in zip(weights, (self.emit, self.pair)))
        else:
            self._train()

    def classes(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        out = list(map(memo.get, words))
        if None in out:
            for w in {w for w, c in zip(words, out) if c is None}:
                row = tuple(self.names.get(f, 0) for f in features(w))
                if (c := self.index.get(row)) is None:
                    c = self.index[row] = len(self.rows)
                    self.rows.append(row)
                    self.scores = None
                memo[w] = c
            out = list(map(memo.__getitem__, words))
        return np.array(out, np.int32)

    def by_class(self) -> np.ndarray:
        """(offset, class, label) scores of the classes seen so far; there are few."""
        if self.scores is None:
            ids = np.array(self.rows)
            self.scores = self.emit[:, ids].sum(2)
            self.scores[:, 0] = self.emit[:, 1]
            self.scores[self.OFFSETS.index(0), :, 0] += CAUTION
        return self.scores

    def _train(self, rounds: int = 120, rate: float = 0.3, l2: float = 0.01) -> None:
        """Likelihood by scaled forward and backward sums, all lines at once; adaptive steps along its gradient."""
        data = [(np.array([[self.names[f] for f in features(w)] for w in words]), np.array(tags)) for words, tags in _table()]
        data.sort(key=lambda x: -len(x[1]))
        n, k, most, width = len(data), len(LABELS), len(data[0][1]), len(self.names)
        tags, mask = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
        ids = np.ones((n, most + 4, _WIDTH), np.int64)  # the edge around
        for i, (x, t) in enumerate(data):
            ids[i, 2 : 2 + len(t)], tags[i, : len(t)], mask[i, : len(t)] = x, t, True
        rows = np.concatenate([(ids[:, 2 + d : 2 + d + most] + o * width)[mask] for o, d in enumerate(self.OFFSETS)], axis=1)  # a row a word
        live = mask.sum(0)  # lines come longest first: those that have a word at t
        gold, pairs = np.eye(k)[tags[mask]], np.zeros((k, k))
        np.add.at(pairs, (tags[:, :-1][mask[:, 1:]], tags[:, 1:][mask[:, 1:]]), 1)
        emit = self.emit.reshape(-1, k)
        seen = [np.full_like(w, 1e-8) for w in (emit, self.pair)]
        psi, fwd, bwd = (np.zeros((n, most, k)) for _ in range(3))
        for _ in range(rounds):
            e = emit[rows].sum(1)
            psi[mask] = np.exp(e - e.max(1, keepdims=True))
            trans = np.exp(self.pair + self.block)
            fwd[:, 0] = psi[:, 0] * np.exp(self.first)
            fwd[:, 0] /= fwd[:, 0].sum(1, keepdims=True)
            for t in range(1, most):
                m = live[t]
                step = (fwd[:m, t - 1] @ trans) * psi[:m, t]
                fwd[:m, t] = step / step.sum(1, keepdims=True)
            bwd[:] = 1.0
            pair = np.zeros((k, k))
            for t in range(most - 1, 0, -1):
                m = live[t]
                ahead = psi[:m, t] * bwd[:m, t]
                back = ahead @ trans.T
                z = (fwd[:m, t - 1] * back).sum(1, keepdims=True)
                pair += (fwd[:m, t - 1] / z).T @ ahead
                bwd[:m, t - 1] = back / back.max(1, keepdims=True)
            p = (fwd * bwd)[mask]
            gap = gold - p / p.sum(1, keepdims=True)
            flat = rows.ravel()
            grads = [np.stack([np.bincount(flat, np.repeat(gap[:, j], rows.shape[1]), len(emit)) for j in range(k)], axis=1) - l2 * emit, pairs - pair * trans - l2 * self.pair]
            for w, g, s in zip((emit, self.pair), grads, seen):
                s += g * g
                w += rate * g / np.sqrt(s)

    def decode(self, words: list[str], starts: np.ndarray) -> list[tuple[int, int, str]]:
        """(first word, end word, kind) in lines that start at ``starts`` of the words."""
        n = len(words)
        if not n:
            return []
        cls = self.classes(words)
        scores = self.by_class()
        line = np.zeros(n, np.int64)
        line[starts[1:]] = 1
        line = np.cumsum(line)
        trans = self.pair + self.block
        e = sum(scores[o][x] for o, x in enumerate(self._near(cls, line)))
        # A path loses to all outside if none of its words gains by its label: its margin, the best pair
        # that leads to it, and the pair to outside behind it. (A first word has no pair before it.)
        lead = np.maximum(trans.max(0) - trans[0, 0], np.where(self.first < 0, -1e4, 0.0)) + np.maximum(0, trans[:, 0] - trans[0, 0])
        hot = (e[:, 1:] + lead[1:]).max(1) > e[:, 0] - 1e-9
        wanted = np.zeros(len(starts), bool)
        wanted[line[hot]] = True
        kept = np.flatnonzero(wanted[line])
        if not len(kept):
            return []
        e, line, hot = e[kept], line[kept], hot[kept]
        n, starts = len(kept), np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        line = np.cumsum(np.append(0, line[1:] != line[:-1]))
        ends = np.append(starts[1:], n)
        rows = np.unique(line[hot])
        out = []
        order = rows[np.argsort((ends - starts)[rows], kind="stable")]
        a = 0
        while a < len(order):  # lines of like length at a time, by the words that they are padded to
            size = (ends - starts)[order[a:]]
            b = a + max(1, int(np.searchsorted(size * np.arange(1, len(size) + 1), CELLS, "right")))
            out += self._viterbi(e, starts[order[a:b]], ends[order[a:b]], trans)
            a = b
        return [(int(kept[a]), int(kept[b - 1]) + 1, kind) for a, b, kind in out]

    def _near(self, cls: np.ndarray, line: np.ndarray) -> Iterator[np.ndarray]:
        """Classes of the words at each offset; the edge where the line ends."""
        for d in self.OFFSETS:
            near = np.zeros(len(cls), np.int32) if d else cls
            if d and len(cls) > abs(d):
                a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
                near[a] = np.where(line[a] == line[b], cls[b], 0)
            yield near

    def _viterbi(self, e: np.ndarray, starts: np.ndarray, ends: np.ndarray, trans: np.ndarray) -> list[tuple[int, int, str]]:
        """Lines come in ascending order of length, so that those which have a word at t are the last ones."""
        size, k = ends - starts, len(LABELS)
        most, rows = int(size.max()), np.arange(len(starts))
        live = np.searchsorted(size, np.arange(most), "right").tolist()
        best = e[starts] + self.first
        back, path = np.zeros((most, len(starts), k), np.int8), np.zeros((most, len(starts)), np.int8)
        for t in range(1, most):
            at = live[t]
            step = best[at:, :, None] + trans
            back[t, at:] = step.argmax(1)
            best[at:] = step.max(1) + e[starts[at:] + t]
        tag = best.argmax(1)
        for t in range(most - 1, -1, -1):
            at = live[t]
            path[t, at:] = tag[at:]
            tag[at:] = back[t, rows[at:], tag[at:]]
        out = []
        for r in np.flatnonzero(path.any(0)).tolist():
            labels, t = path[: size[r], r].tolist(), 0
            while t < len(labels):
                if kind := _BEGIN.get(labels[t]):
                    u = t + 1
                    while u < len(labels) and _INSIDE.get(labels[u]) == kind:
                        u += 1
                    out.append((int(starts[r]) + t, int(starts[r]) + u, kind))
                    t = u
                else:
                    t += 1
        return out


@lru_cache(maxsize=1)
def trained() -> tuple[bytes, bytes]:
    """The field's weights, trained on the driver and sent along with the tasks: some KB."""
    f = Field()
    return f.emit.tobytes(), f.pair.tobytes()


@lru_cache(maxsize=1)
def field(weights: tuple[bytes, bytes]) -> Field:
    return Field(weights)


_WORD = re.compile(r"\S+")


def added_spans(texts: list[str], weights: tuple[bytes, bytes]) -> list[list[tuple[str, int, int]]]:
    """What the field finds in each text, as (kind, start, end) in code points."""
    words: list[str] = []
    starts, owner, found, done = [], [], [], 0
    starts_all, owner_all = [], []

    def flush() -> None:
        nonlocal words, starts, done
        if words:
            found.extend((done + a, done + b, kind) for a, b, kind in field(weights).decode(words, np.array(starts, np.int64)))
        starts_all.extend(done + x for x in starts)
        owner_all.extend(owner)
        done += len(words)
        words, starts = [], []
        owner.clear()

    for i, text in enumerate(texts):
        for line in text.split("\n"):
            if ws := line.split():
                starts.append(len(words))
                owner.append(i)
                words += ws
                if len(words) > WORDS:
                    flush()
    flush()
    starts, owner = starts_all, owner_all
    out: list[list] = [[] for _ in texts]
    if not found:
        return out
    at = np.array(starts)
    first = {}
    for s, i in zip(starts, owner):
        first.setdefault(i, s)
    by_text: dict[int, list] = {}
    for a, b, kind in found:
        by_text.setdefault(owner[int(np.searchsorted(at, a, "right")) - 1], []).append((a, b, kind))
    for i, spans in by_text.items():
        places = [m.span() for m in _WORD.finditer(texts[i])]
        for a, b, kind in sorted(spans):
            s, e = places[a - first[i]][0], places[b - 1 - first[i]][1]
            e = s + len(texts[i][s:e].rstrip(".,:;!?"))
            out[i].append((kind, s, e))
    return out


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: a row a document."""

    bound_batches(docs.sparkSession)
    weights = trained()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 400):
                part = batch.slice(a, 400)
                texts = [t or "" for t in part.column(1).to_pylist()]
                out = []
                for text, more in zip(texts, added_spans(texts, weights)):
                    base = base_spans(text)
                    spans = [(k, s, e) for k in KINDS for s, e in base[k]]
                    digest = hashlib.sha256(_join(spans).encode()).hexdigest()
                    more = [m for m in more if not any(m[1] < e and s < m[2] for _, s, e in spans)]
                    more.sort(key=lambda m: (("name", "address", "id").index(m[0]), m[1]))
                    out.append((*(len(base[k]) for k in KINDS), digest, _join(spans + more), len(more)))
                cols = [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    return rows.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
