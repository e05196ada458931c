"""Text that looks the same but differs in its characters (problem 1).

Strings and code points that look alike are joined to classes by union-find: a
look-alike letter with its plain one, a compatibility form with what it stands
for, a base with its combining accents with the composed letter, an odd space with the
space, an invisible character with nothing. In each class and script the
member that the corpus has most often represents it. One automaton over all members rewrites
a text greedily, longest match first; letters that look alike across scripts
are rewritten by word, into the script that the word's other letters show. Words that
show none (KT in either script) are classes of strings: the spelling that is the most frequent in their context
represents them.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Letters that look like plain Latin ones. Those of RARE alphabets give way only beside letters of another alphabet.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXaesijopcyxhdqwl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ", "ABEZHIKMNOPTYXovj", strict=True))
ARMENIAN = dict(zip("ՍՏՕԼհոսցզօ", "USOLhnugqo", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ", strict=True))
PHONETIC = dict(zip("ɑɡᴄᴏᴠᴡᴢꜱ", "agcovwzs", strict=True))
#: Alphabets by a letter, with their code points as a character class.
ALPHABETS = {"L": "A-Za-zÀ-ɏ", "G": "Ͱ-Ͽ", "C": "Ѐ-ԯ", "A": "\u0530-\u058f", "K": "\u13a0-\u13ff\uab70-\uabbf", "I": "\u0250-\u02af\u1d00-\u1d2b\ua730\ua731"}
RARE = "AKI"
#: Hyphens that look like the plain one, and code points outside category Cf that show nothing.
HYPHENS = "‐‑﹣－"
BLANK = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Control characters that are white space stay as they are.
KEPT = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"
WORD = re.compile(r"[^\W_]+")
#: Respellings go along with the code up to this many; more are joined by shuffle, to the same result.
MAX_SPELLINGS = 100_000
#: Codes are of one alphabet: where this share of a corpus' codes is Latin, a look-alike code is taken for a Latin one even if no rival says so.
CODE_SHARE = 0.95


class UnionFind:
    """Transitive classes over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for x in list(self.parent):
            by.setdefault(self.find(x), []).append(x)
        return [sorted(c) for c in by.values()]


_RANGES = {s: re.compile(f"[{c}]") for s, c in ALPHABETS.items() if s != "L"}


@lru_cache(maxsize=1 << 16)
def script(ch: str) -> str:
    """The alphabet of a letter: L, C or G (Latin, Cyrillic, Greek), A, K or I (Armenian, Cherokee, phonetic), otherwise empty. Compatibility
    forms have that of what they stand for."""
    n = ord(ch)
    if n < 0x250:
        return "L" if ch.isalpha() else ""
    for s, own in _RANGES.items():
        if own.match(ch):
            return s if s == "C" or ch.isalpha() else ""
    plain = unicodedata.normalize("NFKC", ch)
    return "L" if plain != ch and plain[:1].isalpha() and ord(plain[0]) < 0x250 else ""


@lru_cache(maxsize=1)
def alike() -> list[list[str]]:
    """All classes of strings that look alike. "" stands for invisible characters."""
    u = UnionFind()
    for table in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, PHONETIC):
        for a, b in table.items():
            u.union(a, b)
    for h in HYPHENS:
        u.union(h, "-")
    for b in BLANK:
        u.union(b, "")
    for n in range(sys.maxunicode + 1):
        ch = chr(n)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co", "Cs"):
            continue
        if cat == "Cf" or (cat == "Cc" and ch not in KEPT):
            u.union(ch, "")
        elif cat == "Zs":
            u.union(ch, " ")
        elif (d := unicodedata.decomposition(ch)) and n != 0xB5:
            tag = d.split()[0] if d[0] == "<" else ""
            if not tag:  # canonical: the composed letter, its decomposed forms, and single stand-ins such as the Kelvin sign
                whole = unicodedata.normalize("NFC", ch)
                for x in {ch, unicodedata.normalize("NFD", ch)} - {whole}:
                    u.union(x, whole)
            elif tag in ("<wide>", "<narrow>", "<font>", "<noBreak>") or (tag == "<compat>" and (cat[0] == "L" or cat == "Nl")):
                u.union(ch, unicodedata.normalize("NFKC", ch))
    return u.classes()


class Unifier:
    """Rewrites texts. counts: how often the corpus has a string; words: replacements for spellings, by (context, spelling)."""

    def __init__(self, counts: dict[str, int] | None = None):
        counts = counts or {}
        self.across: dict[str, dict[str, str]] = {}
        free: dict[str, str] = {}
        for members in alike():
            by: dict[str, list[str]] = {}
            for m in members:
                by.setdefault(script(m[0]) if m else "", []).append(m)
            # the most frequent; a string of plain letters (fi) counts as more frequent than its ligature; of equals a composed, plain one
            best = {s: min(ms, key=lambda m: (not (len(m) > 1 and m.isalpha()), -counts.get(m, 0), m != unicodedata.normalize("NFKC", m), len(m), m)) for s, ms in by.items()}
            if "" in members:
                best = dict.fromkeys(best, "")
            for s, ms in by.items():
                for m in ms:
                    if m != best[s]:
                        free[m] = best[s]
            if len(best.keys() - {""}) > 1:
                for s, m in best.items():  # a plain letter isn't doubtful because a rare alphabet has its like
                    if s and len(m) == 1 and (s in RARE or len(best.keys() & {*"LCG"}) > 1):
                        self.across[m] = best
        self.automaton = ahocorasick.Automaton()
        for pattern, to in free.items():
            if pattern:
                self.automaton.add_word(pattern, (len(pattern), to))
        self.automaton.make_automaton()
        singles = "".join(sorted(p for p in free if len(p) == 1))
        self.touched = frozenset(singles) | {chr(n) for n in (*range(0x300, 0x370), *range(0x483, 0x488))}
        latin, greek, cyrillic = (ALPHABETS[s] for s in "LGC")
        rare = "".join(ALPHABETS[s] for s in RARE)
        self.foreign = re.compile(f"[{greek}{cyrillic}{rare}]")
        kinds = (latin, greek, cyrillic, rare)
        between = f"[^\\W_{''.join(kinds)}]*"  # letters of no such alphabet, and digits
        #: Where a word turns from one alphabet to another.
        self.turn = re.compile("|".join(f"[{k}]{between}[{''.join(x for x in kinds if x != k)}]" for k in kinds))
        both = "".join(sorted(c for c in self.across if script(c) not in RARE))
        self.bare = re.compile(rf"(?<![^\W_])(?=\d*[{both}])[{both}\d]+(?![^\W_])")
        self.code = re.compile(rf"(?<![^\W_])(?=\d*[{both}])(?:[{both}]*\d[{both}\d]*(?![^\W_])|[{both}]+(?=-\d))")

    def plain(self, text: str) -> str:
        """Rewrites what needs no context, until nothing is left to rewrite (an accent may follow what stood for its base). That comes to an
        end: a rewritten string is its class' representative, and only what stands in it or is joined to it, which is shorter or new, can go on."""
        while not self.touched.isdisjoint(text):
            out, at = [], 0
            for end, (size, to) in self.automaton.iter_long(text):
                out.append(text[at : end + 1 - size])
                out.append(to)
                at = end + 1
            if not at:
                return text
            text = "".join(out) + text[at:]
        return text

    def tells(self, word: str) -> str:
        """The script that the word's letters show: that of most letters which look like no other script's; empty if it has none."""
        seen = Counter(s for c in word if (s := script(c)) and c not in self.across)
        return seen.most_common(1)[0][0] if seen else ""

    def respell(self, word: str, to: str) -> str:
        """The word in a script, as far as its letters have look-alikes there."""
        return "".join(self.across[c].get(to, c) if c in self.across and script(c) != to else c for c in word)

    def _mixed(self, text: str, start: int, end: int) -> str:
        """A word of several alphabets in the one that it shows."""
        word = text[start:end]
        scripts = Counter(filter(None, map(script, word)))
        if len(scripts) < 2:
            return word
        to = self.tells(word)
        if not to:
            near = self.context(text, start, end)
            to = near if near in scripts else scripts.most_common(1)[0][0] if near != "#" else "L"
        return self.respell(word, to)

    def _unmix(self, text: str) -> str:
        out, at = [], 0
        for m in self.turn.finditer(text):
            start, end = m.span()
            if start < at:
                continue  # the same word turns again
            while start and text[start - 1].isalnum():
                start -= 1
            while end < len(text) and text[end].isalnum():
                end += 1
            out += [text[at:start], self._mixed(text, start, end)]
            at = end
        return "".join(out) + text[at:]

    def context(self, text: str, start: int, end: int) -> str:
        """What a word without a telling letter stands by: # for digits (A0, KT-57294), otherwise the script of the nearest
        word in its line that has one, the left one of two; empty if there is none."""
        if re.match(r"-\d", text[end : end + 2]) or any(map(str.isdigit, text[start:end])):
            return "#"
        lo, hi = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        left = next((s for w in reversed(WORD.findall(text[lo:start])) if (s := self.tells(w))), "")
        return left or next((s for w in WORD.findall(text[end : hi if hi >= 0 else len(text)]) if (s := self.tells(w))), "")

    def spellings(self, text: str) -> list[tuple[str, str, str]]:
        """(skeleton, context, spelling) of the words without a telling letter; skeleton is the spelling in Latin. Takes text that has
        been through unmixed and is not all Latin."""
        return [(self.respell(m.group(), "L"), self.context(text, *m.span()), m.group()) for m in self.bare.finditer(text)]

    def latin_spellings(self, text: str) -> Counter:
        """The same, counted, of a text that is all Latin: its spellings never give way, they only count."""
        codes = Counter(self.code.findall(text))
        rest = Counter(self.bare.findall(text))
        rest.subtract(codes)
        return Counter({(w, "L", w): n for w, n in rest.items() if n > 0}) + Counter({(w, "#", w): n for w, n in codes.items()})

    def unmixed(self, text: str) -> str:
        """plain, and words of mixed scripts in the script that they show."""
        text = self.plain(text)
        if text.isascii():
            return text
        return self._unmix(text) if self.foreign.search(text) else text

    def rewrite(self, text: str, words: dict[tuple[str, str], str] | None = None) -> str:
        text = self.unmixed(text)
        if not words or text.isascii() or not self.foreign.search(text):
            return text
        at, out = 0, []
        for m in self.bare.finditer(text):
            to = words.get((self.context(text, *m.span()), m.group()))
            if to is not None:
                out += [text[at : m.start()], to]
                at = m.end()
        return "".join(out) + text[at:]


@lru_cache(maxsize=2)
def _unifier(counts: tuple[tuple[str, int], ...]) -> Unifier:
    return Unifier(dict(counts))


_MARKS = re.compile("[^̀-ͯ][̀-ͯ]+")


def count_strings(texts: DataFrame) -> tuple[tuple[str, int], ...]:
    """How often the column text has each code point, and each base with its combining marks, of those that some class holds. There
    are at most as many as all classes have members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {m for c in alike() for m in c}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            points = np.bincount(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
            rows = [(c, int(points[ord(c)])) for c in map(chr, np.flatnonzero(points).tolist()) if c in known]
            marked = Counter(m for t in texts if not t.isascii() for m in _MARKS.findall(t))
            rows += [(s, n) for s, n in marked.items() if s in known]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["s", "n"])

    got = texts.select("text").where("text is not null").mapInArrow(run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    return tuple(sorted((r.s, r.n) for r in got))


_FIELD = "table_name string, field_name string, record_id string, page int, line int"
_KEY = ["table_name", "field_name", "record_id", "page", "line"]


def _row() -> Column:
    """A number for a field's key and text. A null has a place of its own; rows that share a number share no more than their respellings."""
    return F.xxhash64(*(x for c in _KEY for x in (F.col(c), F.col(c).isNull())), "text").alias("_row")


_WORDS = "array<struct<skeleton string, context string, spelling string, n long>>"


def _survey(counts: tuple[tuple[str, int], ...]):
    kind = pa.list_(pa.struct([("skeleton", pa.string()), ("context", pa.string()), ("spelling", pa.string()), ("n", pa.int64())]))
    listed = lambda seen: [{"skeleton": a, "context": b, "spelling": c, "n": n} for (a, b, c), n in seen.items()]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = _unifier(counts)
        for batch in batches:
            out, latin = [], []
            for *key, text in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                new = u.unmixed(text)
                if new.isascii() or not u.foreign.search(new):
                    latin.append(new)
                    if new != text:
                        out.append((*key, True, []))
                else:
                    out.append((*key, new != text, listed(Counter(u.spellings(new)))))
            out.append((None, None, None, None, None, None, False, listed(u.latin_spellings("\n".join(latin)))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[*_KEY, "_row", "changed", "words"])

    return run


def survey(fields: DataFrame, counts: tuple[tuple[str, int], ...]) -> DataFrame:
    """The fields that change whatever their neighbours are, or that aren't all Latin, with their words without a telling letter. Rows
    without a key count those words of the all-Latin fields, per batch."""
    return fields.select(*_KEY, _row(), "text").where("text is not null").mapInArrow(_survey(counts), f"{_FIELD}, _row long, changed boolean, words {_WORDS}")


def respellings(surveyed: DataFrame) -> DataFrame:
    """(context, spelling, to): spellings that give way to the most frequent one of their class in their context. By digits, a
    spelling gives way to the Latin one where CODE_SHARE of all codes are Latin: most codes stand once, so counting each against its own rivals settles nothing."""
    each = surveyed.select(F.explode("words").alias("w")).groupBy("w.skeleton", "w.context", "w.spelling").agg(F.sum("w.n").alias("n"))
    by = Window.partitionBy("skeleton", "context")  # at most one row per spelling of a word
    best = F.max(F.struct("n", (F.col("spelling") == F.col("skeleton")).alias("latin"), "spelling")).over(by)["spelling"]
    latin = F.sum(F.when(F.col("spelling") == F.col("skeleton"), F.col("n")).otherwise(0))
    share = each.groupBy("context").agg((latin / F.sum("n")).alias("latin_share"))
    each = each.withColumn("to", best).join(F.broadcast(share), "context")  # share has one row per context: five at most
    to = F.when((F.col("context") == "#") & (F.col("latin_share") >= CODE_SHARE), F.col("skeleton")).otherwise(F.col("to"))
    return each.select("context", "spelling", to.alias("to")).where("spelling <> to")


def found(fields: DataFrame) -> DataFrame:
    """The keys of the fields (table_name, field_name, record_id, page, line, text) that the rewriting changes, each once. A null text
    is no field; an empty one never changes."""
    from evenfold.session import cut

    seen = cut(survey(fields, count_strings(fields)))
    bad = respellings(seen).select(F.struct("context", "spelling").alias("b"))
    hit = seen.where(~F.col("changed")).select(*_KEY, F.explode("words").alias("w")).withColumn("b", F.struct("w.context", "w.spelling")).join(bad, "b", "left_semi")
    return seen.where("changed").select(*_KEY).unionByName(hit.select(*_KEY)).distinct()


def unify(fields: DataFrame) -> DataFrame:
    """The fields with text rewritten, as many rows as have a text; a null in the key changes nothing. Up to MAX_SPELLINGS respellings go
    with the code; beyond that, each field is joined with its own."""
    from evenfold.session import cut

    counts = count_strings(fields)
    seen = cut(survey(fields, counts))
    bad = cut(respellings(seen))
    few = bad.limit(MAX_SPELLINGS + 1).collect()
    rows = fields.where("text is not null")
    if len(few) <= MAX_SPELLINGS:
        words = {(r.context, r.spelling): r.to for r in few}
        rows = rows.withColumn("respell", F.lit(None).cast("map<string,string>"))
    else:
        words = {}
        own = seen.where("_row is not null").select("_row", F.explode("words").alias("w")).select("_row", "w.context", "w.spelling").distinct().join(bad, ["context", "spelling"])
        own = own.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("context", F.lit(" "), "spelling"), "to"))).alias("respell"))  # of one text
        rows = rows.withColumn("_row", _row()).join(own, "_row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = _unifier(counts)
        for batch in batches:
            new = []
            for text, own in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                mine = {tuple(k.split(" ")): v for k, v in own} if own else words
                new.append(u.rewrite(text, mine))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(new, pa.string())], names=[*_KEY, "text"])

    return rows.select(*_KEY, "text", "respell").mapInArrow(run, f"{_FIELD}, text string")
