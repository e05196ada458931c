"""The text operators against brute force, round trips and odd rows."""

import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evenfold.llm import fieldhash, leaks, lookalike, mixing, scannoise, spans

FIELDS = "table_name string, field_name string, record_id string, page int, line int, text string"


# problem 1
@pytest.fixture(scope="module")
def unifier():
    return lookalike.Unifier()


@pytest.mark.parametrize("raw,want", [
    ("ＥＵＲ １２", "EUR 12"), ("𝐒𝐞𝐢𝐭𝐞 𝚊𝚗𝚍", "Seite and"), ("café è", "café è"), ("perch​é", "perché"), ("a​­b﻿", "ab"), ("a b　c", "a b c"),
    ("ﬁne ﬂow", "fine flow"), ("Оrdеr thе", "Order the"), ("Дeтaль лecтницa", "Деталь лестница"), ("Τhe νοn", "The von"), ("m² ½ № °", "m² ½ № °"),
    ("Ꭺpple", "Apple"), ("օbject", "object"), ("ɑpple", "apple"), ("кօмната", "комната"), ("հայերեն ᏣᎳᎩ", "հայերեն ᏣᎳᎩ"), ("pʌɹɑ", "pʌɹɑ"),
    ("но не камера", "но не камера"), ("plain text\tand\n\x0cmore", "plain text\tand\n\x0cmore"), ("", ""), ("й", "й"), ("K", "K"), ("a‑b", "a-b"),
])
def test_unmixed(unifier, raw, want):
    assert unifier.unmixed(raw) == want
    assert unifier.unmixed(want) == want


def test_classes_are_transitive():
    u = lookalike.UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c")):
        u.union(a, b)
    assert u.classes() == [["a", "b", "c", "d"]]
    by = {m: i for i, c in enumerate(lookalike.alike()) for m in c}
    assert by["a"] == by["а"] == by["ａ"] == by["𝐚"] and by["o"] == by["о"] == by["ο"] and by["é"] == by["é"] and by["​"] == by[""]


def test_found_and_unified(spark):
    plain = [("t", "f", f"r{i}", 0, 0, "Деталь KT-57294: и камера X0\nTotal KT-11111") for i in range(60)]
    odd = [("t", "f", "x", 1, 1, "Деталь КТ-57294 была"), ("t", "f", "y", 1, 1, "clean"), ("t", "f", "y", 1, 2, None), ("t", "f", "z", 1, 1, ""), ("t", "f", "w", 1, 1, "Оrder"), ("t", "f", "w", 1, 1, "Оrder")]
    df = spark.createDataFrame(plain + odd, FIELDS)
    assert {r.record_id for r in lookalike.found(df).collect()} == {"x", "w"} and lookalike.found(df).count() == 2
    new = {(r.record_id, r.line): r.text for r in lookalike.unify(df).collect()}
    assert new["x", 1] == "Деталь KT-57294 была" and new["w", 1] == "Order" and new["z", 1] == ""
    assert lookalike.found(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [0, 100_000])
def test_unify_on_both_sides_of_the_bound(spark, monkeypatch, bound):
    """Null keys, repeated keys and repeated rows: the bound is one of plans, not of results."""
    rows = [("t", "f", f"r{i}", 0, 0, "Деталь KT-57294") for i in range(40)]
    odd = [("t", "f", None, None, None, "Деталь КТ-57294"), (None, None, None, None, None, "Деталь КТ-57294"), ("t", "f", "x", 1, 1, "Деталь КТ-57294"), ("t", "f", "x", 1, 1, "Деталь КТ-57294"), ("t", "f", "x", 1, 1, "и КТ-57294")]
    monkeypatch.setattr(lookalike, "MAX_SPELLINGS", bound)
    got = Counter(tuple(r) for r in lookalike.unify(spark.createDataFrame(rows + odd, FIELDS)).collect())
    assert got == Counter([*rows, *((*r[:5], r[5].replace("КТ", "KT")) for r in odd)])


def test_codes_follow_the_corpus(spark):
    """A lone code of look-alikes is Latin where nearly all codes are, and stays where they aren't."""
    codes = lambda n, m: [("t", "f", f"r{i}", 0, 0, "Деталь " + ("AX" if i < n else "КТ") + f"-{i}") for i in range(n + m)]
    for rows, want in ((codes(40, 1), 1), (codes(5, 5), 0)):
        assert lookalike.found(spark.createDataFrame(rows, FIELDS)).count() == want


def test_plain_comes_to_rest(unifier):
    """Accents may follow what stood for their base, any number of times."""
    rng = random.Random(6)
    members = [m for c in lookalike.alike() for m in c if m]
    for _ in range(3000):
        text = "".join(rng.choice(members) if rng.random() < 0.7 else rng.choice("aeo\u0301\u0308\u200b") for _ in range(12))
        assert unifier.plain(unifier.plain(text)) == unifier.plain(text)


# problem 3
TRUE = ["the supervisor confirmed the delivery of the western girder", "drawing of the calibration and of the boiler", "the ventilator was calibrated again by the auditor"]


@pytest.fixture(scope="module")
def reader():
    counts = Counter(w for line in TRUE for w in line.split())
    return scannoise.Reader({w: n * 50 for w, n in counts.items()}, {("the", "girder"): 9}, 3)


@pytest.mark.parametrize("word,want", [
    ("supervlsor", "supervisor"), ("veritilator", "ventilator"), ("clrawinq", None), ("bo1ler", "boiler"), ("westem", "western"), ("sup~ervisor", "supervisor"), ("calibrafed", "calibrated"),
    ("oudifor", None), ("girder", None), ("zzz", None), ("girderx", None),
])
def test_misread_words(reader, word, want):
    got = reader.rivals(word)
    assert (got[0][0] if got else None) == want


def test_automaton_is_complete(reader):
    """Plain edits: against all words of the vocabulary one letter away."""
    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    rng = random.Random(4)
    for word in list(reader.trie.counts) * 3:
        i, c = rng.randrange(len(word) + 1), rng.choice(string.ascii_lowercase)
        for odd in (word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :]):
            want = {w for w in reader.trie.counts if near(w, odd)}
            assert want <= set(reader.trie.candidates(odd, plain=True))


@pytest.fixture(scope="module")
def neighbours():
    counts, pairs = Counter(w for line in TRUE for w in line.split()), Counter(p for line in TRUE for p in zip(line.split(), line.split()[1:], strict=False))
    return scannoise.Reader({w: n * 50 for w, n in counts.items()} | {"s235": 500, "s236": 2}, {p: n * 50 for p, n in pairs.items()}, 3)


@pytest.mark.parametrize("line,want", [
    ("the supervisor confirmed the delivexy of the western girder", True), ("the ventlator was calibrated again by the auditor", True), ("the ventilator was calibratedd again by the auditor", True),
    ("drawinq of the calibration", True), ("confirmed the cle1ivery of the", True), ("a girderx", False), ("the girderx stands alone", False), ("delivexy of the western", False), ("the supervisor bay the western girder", False),
])
def test_misread_by_neighbours(neighbours, line, want):
    """One plain edit, or confusions of two kinds, where both neighbours call for the true word; not where one is missing or knows nothing of it."""
    assert {(n, k) for n, k in scannoise.noise_of(line + "\nand so on.", neighbours) if k == "misread"} == ({(1, "misread")} if want else set())


def test_misread_by_neighbours_over_lines(neighbours):
    got = lambda text: sorted(n for n, k in scannoise.noise_of(text, neighbours) if k == "misread")
    assert got("the supervisor confirmed the\ndelivexy of the western\ngirder.") == [2]
    assert got("the supervisor confirmed the deli-\nvexy of the western girder.") == [2] and got("the supervisor confirmed the dxli-\nvery of the western girder.") == [1]
    assert scannoise.repair_text("the supervisor confirmed the delivexy of the western girder.", neighbours) == "the supervisor confirmed the delivery of the western girder."


def test_found_uses_neighbours(spark, tmp_path):
    """The registered query, not the automaton alone."""
    from evenfold.llm.queries import p3_found

    spark.createDataFrame([(f"o{i}", line) for i in range(40) for line in TRUE] + [("x", "the supervisor confirmed the delivexy of the western girder.")], "observation_id string, raw_text string").write.parquet(str(tmp_path / "raw_observations.parquet"))
    spark.createDataFrame([(1, "g", "original", 1, 1, "the ventlator was calibrated again")], "line_id long, group_id string, variant string, page int, line int, text string").write.parquet(str(tmp_path / "ocr_lines.parquet"))
    assert {(r.table_name, r.record_id) for r in p3_found(spark, str(tmp_path)).where("kind = 'misread'").collect()} == {("raw_observations", "x"), ("ocr_lines", "1")}


@pytest.mark.parametrize("token,want", [("834.l4", True), ("7537,b8", True), ("12/#1/2022", True), ("TE-8920B", True), ("T3-89208", True), ("TE-89208", False), ("834.14", False), ("2022-01-07", False), ("J19", False), ("word", None)])
def test_numbers(reader, token, want):
    assert reader.number(token) is want


def test_confusions_keep_the_key():
    assert all(scannoise.fold(true) == scannoise.fold(read) for true, read in scannoise.CONFUSIONS)


def words_table(spark, seed=8):
    """Words with counts: random ones, some of their misreadings and plain edits."""
    rng = random.Random(seed)
    counts = Counter()
    for _ in range(150):
        word = "".join(rng.choice("acdeghilmnorstu") for _ in range(rng.randrange(4, 9)))
        counts[word] += rng.choice([1, 3, 8, 20, 200])
        for true, read in rng.sample(scannoise.CONFUSIONS, 6):
            if true in word:
                counts[word.replace(true, read, 1)] += rng.choice([1, 2, 9])
    return counts, spark.createDataFrame([(w, "", n) for w, n in counts.items()], "a string, b string, n long")


@pytest.mark.parametrize("share", [2e-6, 1e-3, 2e-2])
def test_rare_words_are_judged_alike(spark, monkeypatch, share):
    """However few words are frequent enough for the trie, all others meet their rivals by key: against the automaton over all words."""
    monkeypatch.setattr(scannoise, "SHARE", share)
    counts, seen = words_table(spark)
    words, pairs, least = scannoise.vocabulary(seen)
    bc = spark.sparkContext.broadcast(scannoise._Shipped(f"t{share}", words, pairs, least))
    got = {r.word: (r.own, {(x["true"], x["n"]) for x in r.near}) for r in scannoise.judged(seen, bc, least).collect() if r.near}
    trie = scannoise.Trie(counts)
    want = {w: (n, near) for w, n in counts.items() if len(w) > 2 and not w.isdigit() and (near := {(t, counts[t]) for t in trie.candidates(w) if counts[t] >= max(scannoise.RARER * n, 3)})}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("share", [2e-6, 5e-3])
def test_verdicts_by_broadcast_or_join(spark, monkeypatch, share):
    """Both ways of bringing verdicts to the texts give the same rows and repairs."""
    monkeypatch.setattr(scannoise, "SHARE", share)
    texts = spark.createDataFrame([(f"o{i}", line) for i in range(30) for line in TRUE] + [("x", "the supervlsor confirmed the deli-\nvexy of the westem girder\n\nand the bo1ler"), ("y", "the ventlator was calibrated again"), ("n", None), ("e", "")], "record_id string, text string")
    lines = spark.createDataFrame([(1, "g", "v", 1, 1, "the supervlsor confirmed the deli-"), (2, "g", "v", 1, 2, "very of the westem girder")], "line_id long, group_id string, variant string, page int, line int, text string")
    out = []
    for bound in (0, 300_000):
        monkeypatch.setattr(scannoise, "MAX_VERDICTS", bound)
        known = scannoise.ship(texts)
        assert (known.table is None) == (bound > 0)
        out.append([sorted(map(tuple, f.collect()), key=str) for f in (scannoise.text_noise(texts, known), scannoise.line_noise(lines, known), scannoise.repair(texts, known))])
    assert out[0] == out[1] and len(out[0][0]) > 3 and len(out[0][1]) == 3


@pytest.mark.parametrize("text,want", [("i", 1), ("iv", 4), ("xiv", 14), ("XL", 40), ("ccxix", 219), ("iil", 3), ("v1i", 7), ("iiii", None), ("abc", None), ("", None), ("1", 1), ("mm", None)])
def test_roman_numbers(text, want):
    assert scannoise.roman(text) == want


def test_roman_pages_and_edges():
    """Roman page numbers go on from page to page; a header at the text's top or foot counts as one beside a break."""
    lines = "ALPHA WORKS 2015\nThe boiler was\nrepaired\ni\nbefore the audit\n52\nii\nand closed.\niil\nALPHA WORKS 2015".split("\n")
    assert scannoise.furniture(lines) == {0: "header", 3: "page_number", 6: "page_number", 8: "page_number", 9: "header"}
    assert scannoise.furniture(["i am", "ii", "text"]) == {} and scannoise.furniture(["text", "more", "iv"]) == {2: "page_number"} and scannoise.furniture([""]) == {}
    assert scannoise._chain([(0, 5), (1, 1), (2, 9), (3, 2), (4, 6), (5, 3)]) == [1, 3, 5] and scannoise._chain([]) == []


TEXT = """Alpha Works - Girder LM-71334
The auditor has confirmed the deli-
very of the western
[1/3]
Alpha Works - Girder LM-71334
52
girder. The boiler was cali-
[2/3]
Alpha W0rks - Girder LM-71334
brated again by the super=
visor.
Anhang -

[3/3]"""


def test_furniture_and_hyphens(reader):
    got = set(scannoise.noise_of(TEXT, reader))
    assert {(n, k) for n, k in got if k != "misread"} == {
        (4, "page_number"), (8, "page_number"), (14, "page_number"), (1, "header"), (5, "header"), (9, "header"), (2, "hyphen"), (7, "hyphen"), (10, "hyphen")}
    text = scannoise.repair_text(TEXT, reader)
    assert "delivery of the western 52 girder" in text or "delivery of the western" in text
    assert "calibrated again by the supervisor." in text and "[2/3]" not in text and "Girder" not in text


def test_noise_on_odd_rows(spark):
    long = "\n".join(TRUE * 200) + "\nthe supervlsor"
    texts = spark.createDataFrame([("a", long), ("b", None), ("c", ""), (None, "x"), ("d", "the girdcr is the\nwestern"), ("d", "the girdcr is the\nwestern")], "record_id string, text string")
    bc = scannoise.ship(texts)
    got = scannoise.text_noise(texts, bc).collect()
    assert {(r.record_id, r.line_no, r.kind) for r in got} == {("d", 1, "misread")} and len(got) == 1
    assert {r.record_id for r in scannoise.repair(texts, bc).collect()} == {"a", "b", "c", "d", None}
    rows = []
    for v in ("o", "r"):
        for page in (1, 2, 3):
            body = ["Alpha Works - Girder   %d" % page, "own words %s" % ("xyz"[page - 1] * 9), "the supervisor confirmed the deli-", "very of the", "last words %s" % ("xyz"[page - 1] * 9), "[%d/3]" % page]
            rows += [(len(rows) + i, "g", v, page, i + 1, t, "x") for i, t in enumerate(body)]
    rows += [(90, "g", "o", 1, 9, None, "x"), (None, "g", "o", 1, 9, "x", "x"), (91, None, None, 1, 1, "y", "x")]
    lines = spark.createDataFrame(rows, "line_id long, group_id string, variant string, page int, line int, text string, kind string")
    kinds = Counter(r.kind for r in scannoise.line_noise(lines, bc).collect())
    assert kinds == {"header": 6, "page_number": 6, "hyphen": 6}
    assert scannoise.line_noise(lines.limit(0), bc).count() == 0 and scannoise.text_noise(texts.limit(0), bc).count() == 0


LINES = "line_id long, group_id string, variant string, page int, line int, text string"


def test_repaired_covers_both_tables(spark, sf):
    """Every row of raw_observations and every reading of ocr_lines comes out, once."""
    from evenfold.llm.queries import p3_repaired

    rows = p3_repaired(spark, sf).collect()
    readings = {(r.group_id, r.variant) for r in spark.read.parquet(f"{sf}/ocr_lines.parquet").select("group_id", "variant").collect()}
    got = [(r.record_id, r.variant) for r in rows if r.table_name == "ocr_lines"]
    assert len(got) == len(set(got)) and set(got) == readings and all(r.text for r in rows if r.table_name == "ocr_lines")
    assert len(rows) - len(got) == spark.read.parquet(f"{sf}/raw_observations.parquet").count()


@pytest.mark.parametrize("bound", [0, 300_000])
def test_readings_are_repaired(spark, monkeypatch, bound):
    """Paragraphs over the pages of a reading: furniture dropped, words joined over a page break, a row that comes twice counted once; nothing else is lost."""
    monkeypatch.setattr(scannoise, "MAX_VERDICTS", bound)
    pages = [["Alpha Works - Girder LM-71334", "the supervlsor confirmed the delivery of the western girder", "the supervlsor confirmed the delivery of the western girder", "drawing of the calibration and of the boiler, the deli-", "[1/2]"],
             ["Alpha Works - Girder LM-71334", "very of the westem girder and the bo1ler", "drawing of the calibration and of the boiler.", "[2/2]"]]
    rows = [(p * 10 + i, "g", "v", p, i - (p == 1 and i > 2), t) for p, page in enumerate(pages, 1) for i, t in enumerate(page, 1)]
    odd = [(90, "g", "w", 1, 1, "the gir-"), (91, "g", "w", 1, 2, "the g1r-"), (92, "g", "w", 1, 3, "der"), (93, "n", "v", 1, 1, None), (94, None, None, 1, 1, "the boiler"), (95, "h", "v", 2, None, "last"), (96, "h", "v", 2, 1, "the"), (None, "h", "v", None, 1, "girder")]
    lines = spark.createDataFrame([*reversed(rows), *odd], LINES)
    known = scannoise.ship(spark.createDataFrame([(line,) for line in TRUE * 30], "text string").unionByName(lines.select("text")))
    got = {(r.group_id, r.variant): r.text for r in scannoise.repair_readings(lines, known).collect()}
    whole = "the supervisor confirmed the delivery of the western girder drawing of the calibration and of the boiler, the delivery of the western girder and the boiler drawing of the calibration and of the boiler."
    assert got == {("g", "v"): whole, ("g", "w"): "the girder", ("n", "v"): None, (None, None): "the boiler", ("h", "v"): "the last girder"}
    assert scannoise.repair_readings(lines.limit(0), known).count() == 0


def test_prose_beside_wide_fields(reader):
    """Running text is joined however wide the fields beside it are; a sentence goes on over a colon, a mark and a line of a number."""
    fields = "Supplier: Alpha Works; Approved: 02/11/2021; Unit price: 185.21 EUR; Order: LM-71334"
    prose = "The auditor has confirmed that the\nwestern girder was calibrated\nagain and the boiler de|livered\nby the supervisor."
    assert scannoise.repair_text(f"{prose}\n{fields}\n{fields}", reader) == f"{prose.replace('|', '').replace(chr(10), ' ')}\n\n{fields}\n\n{fields}"
    assert scannoise.repair_text("Part LM-71334: the boiler and the\nwestern girder were calibrated and\n38\nthe boiler again.", reader) == "Part LM-71334: the boiler and the western girder were calibrated and 38 the boiler again."
    assert scannoise.repair_text("Order: LM-71334\nThe auditor has confirmed that the\norder: lm-71334", reader).count("\n\n") == 2


@pytest.mark.parametrize("word,want", [("Corm0rel", "Cormorel"), ("sto1dor", "stoldor"), ("Kent1lor", "Kentilor"), ("кил8ин", "килвин"), ("Ro5mer", "Rosmer"), ("S0-71334", "SO-71334"), ("12-7l334", "12-71334")])
def test_names_get_letters(reader, word, want):
    """A misread name that no word of the vocabulary explains, and the letters of a code."""
    assert reader.misread(word) and scannoise.repair_text(f"the {word} boiler", reader) == f"the {want} boiler"


# problem 7
def test_copies(spark):
    rows = [
        (1, "g", "Order No: DC-16435; Weight: 340.79 kg", "f"), (2, "g", "weight = 340.79 KG | order no dc 16435.", None), (3, "g", "Order No: DC-16435; Weight: 340,79 kg", "f"),
        (4, "g", "Weight 340.79 kg Order No DC 16435", "f"), (5, "h", "order no: DC-16435; Weight: 340.79 kg", "f"), (6, "g", "...", "f"), (7, "g", None, "f"), (None, "g", "x", "f"),
        (8, None, "a; a; b", "f"), (9, None, "a; b; b", "f"), (10, None, "b;a;a;", "f"), (10, None, "b;a;a;", "f"), (11, "g", "Straße 5", "f"), (12, "g", "STRASSE 5", "f"),
        (13, "g", "Nr 12\u00a0345", "f"), (14, "g", "nr 12 345", "f"), (15, "g", "nr 12_345", "f"),
    ]
    df = spark.createDataFrame(rows, "line_id long, group_id string, text string, f string")
    assert sorted(map(tuple, fieldhash.copies(df, ["group_id"]).collect())) == [(1, 2), (8, 10), (11, 12), (13, 14)]
    counted = {r.first_line_id: r.n_copies for r in fieldhash.counts(df, ["group_id"]).collect()}
    assert counted == {1: 2, 3: 1, 4: 1, 5: 1, 8: 2, 9: 1, 11: 2, 13: 2, 15: 1}
    assert fieldhash.copies(df.limit(0), ["group_id"]).count() == 0


def test_names_and_values_stay_apart(spark):
    """With named, the boundary between a field's name and its value and the signs of numbers count; without, as in the line tables, they are dress."""
    rows = [(1, "name: a b"), (2, "name a: b"), (3, "NAME : A  B"), (4, "temp: -5; scale 1:5"), (5, "temp: 5; scale 1:5"), (6, "Scale 1:5 | temp=-5"), (7, "name a b"), (8, "t-5"), (9, ":"), (None, "name: a b")]
    df = spark.createDataFrame([(i, None, x) for i, x in rows], "line_id long, g string, text string")
    got = lambda **k: {(r.first_line_id, r.line_id) for r in fieldhash.copies(df, ["g"], **k).collect()}
    assert got(named=True) == {(1, 3), (4, 6)} and got() == {(1, 2), (1, 3), (1, 7), (4, 5), (4, 6)}
    assert {(r.first_line_id, r.n_copies) for r in fieldhash.counts(df, ["g"], named=True).collect()} == {(1, 2), (2, 1), (4, 2), (5, 1), (7, 1), (8, 1)}


def test_counts_are_verified(spark, monkeypatch):
    """Lines whose fingerprints collide are told apart by their fields."""
    monkeypatch.setattr(fieldhash, "multiset_hash", lambda fields, seed: F.lit(0).cast("long"))
    df = spark.createDataFrame([(1, "g", "a"), (2, "g", "b"), (3, "g", "A")], "line_id long, g string, text string")
    assert {(r.first_line_id, r.n_copies) for r in fieldhash.counts(df, ["g"]).collect()} == {(1, 2), (2, 1)}


# problem 8
def brute_leaks(docs, items, k):
    grams = {(i, tuple(w[j : j + k])) for i, t in items if t is not None and i is not None for w in [leaks.words_of(t)] for j in range(len(w) - k + 1)}
    by = {}
    for i, g in grams:
        by.setdefault(g, set()).add(i)
    return {(i, d) for d, t in docs if t and d is not None for w in [leaks.words_of(t)] for j in range(len(w) - k + 1) for i in by.get(tuple(w[j : j + k]), ())}


@pytest.mark.parametrize("block", [200_000, 40])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", block)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(6)] + ["Größe", "É"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 25)))) for i in range(30)] + [(99, None), (None, "a b"), (98, "")]
    docs = [(d, ", ".join(w.upper() for w in rng.choices(vocabulary, k=rng.randint(0, 60)))) for d in range(80)]
    docs += [(200 + i, f"x y {t} z") for i, (_, t) in enumerate(items[:10])] + [(300, None), (None, items[0][1]), (301, "")]
    docs.append((302, "q " * 5000 + items[1][1]))
    for k in (3, 5):
        got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"), k)
        assert {(r.item_id, r.doc_id) for r in got.collect()} == brute_leaks(docs, items, k)


def test_clean(spark):
    item = " ".join(f"w{i}" for i in range(15))
    docs = [(1, f"Before {item}, after " + "x " * 30), (2, f"{item}!"), (3, "nothing")]
    got = {r.doc_id: r for r in leaks.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1].text.startswith("Before , after x") and got[1].n_removed == 15 and got[2].text is None and set(got) == {1, 2}


# problem 9
def test_knapsack_is_exact():
    rng = random.Random(9)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(5)}
        budget = rng.randint(1, 150)
        reach = {0}
        for n, c in counts.items():
            reach = {a + n * k for a in reach for k in range(c + 1)}
        took = mixing.knapsack(budget, counts)
        assert sum(n * c for n, c in took.items()) == max(a for a in reach if a <= budget)
        assert all(took[n] <= counts[n] for n in took)
    big = {n: 5000 for n in range(50, 900)}
    for budget in (10, 70_000, 12_345_678, 10**9):
        took = mixing.fit(budget, big)
        assert budget - sum(n * c for n, c in took.items()) == 0 or budget < 50
        assert all(0 <= took[n] <= 5000 for n in took)


def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["a"] * 8 + ["b", None, "c"]), " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 60)))) for i in range(400)]
    docs += [(500, "a", None), (501, "b", ""), (None, "a", "x")]
    targets = [("a", 0.5, 1), ("b", 0.5, 3), ("nobody", 0.2, 2), ("zero", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("copies", F.lit(7))
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, t)
    got = {r.doc_id: r for r in mixed.collect()}
    assert len(got) == 402
    assert all(r.copies <= {"a": 1, "b": 3}.get(r.source, 0) for r in got.values())
    used = Counter()
    for r in got.values():
        used[r.source] += r.copies * r.n_tokens
    assert abs(used["a"] - used["b"]) <= 1 and max(r.copies for r in got.values() if r.source == "b") == 3
    assert got == {r.doc_id: r for r in mixing.mix(df.repartition(7), t).collect()}
    rows = {r.source: r for r in mixing.shares(mixed, t).collect()}
    assert rows["a"].actual_share == pytest.approx(0.5, abs=1e-3) and rows["nobody"].n_used is None
    assert mixing.mix(df.limit(0), t).count() == 0


# problem 10
def brute_spans(docs, n):
    own, multi = {}, set()
    for d, t in docs:
        for i in range(len(t) - n + 1):
            if own.setdefault(t[i : i + n], d) != d:
                multi.add(t[i : i + n])
    out = set()
    for d, t in docs:
        hit = [any(t[i : i + n] in multi for i in range(max(0, p - n + 1), min(p, len(t) - n) + 1)) for p in range(len(t))]
        p = 0
        while p < len(t):
            if hit[p]:
                q = p
                while q < len(t) and hit[q]:
                    q += 1
                out.add((d, p, q))
                p = q
            p += 1
    return out


@pytest.mark.parametrize("alphabet,piece", [("ab", 1 << 18), ("abcdef 𝐚é", 1 << 18), ("abc", 64), ("a", 1 << 18)])
def test_shared_spans(spark, monkeypatch, alphabet, piece):
    monkeypatch.setattr(spans, "PIECE", piece)
    spans._powers.cache_clear()
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices(alphabet, k=n))
    shared = [text(rng.randint(15, 60)) for _ in range(8)]
    docs = [(i, text(rng.randint(0, 50)) + rng.choice(shared)[rng.randint(0, 8) :] + text(rng.randint(0, 50)) + rng.choice(shared)) for i in range(40)]
    docs += [(50, docs[0][1]), (51, docs[0][1]), (52, ""), (53, "short"), (54, shared[0] + shared[0])]
    n, block = 20, 7
    df = spark.createDataFrame([*docs, (60, None), (None, shared[0] * 2)], "doc_id long, text string").withColumn("lo", F.lit(1))
    # the kernels run with this PIECE only in this process, so the pieces are tried here and the plan with the usual ones
    for _, t in docs:
        runs = [(at + a, at + b) for at, p in spans.pieces(t, n) for _, _, a, b in zip(*spans.anchored(p, n, block), strict=True)]
        assert sorted(w for a, b in runs for w in range(a, b + 1)) == list(range(max(0, len(t) - n + 1)))
    got = {(r.doc_id, r.start_pos, r.end_pos) for r in spans.shared_spans(df, n, block).collect()}
    assert got == brute_spans(docs, n)
    spans._powers.cache_clear()


def test_no_spans(spark):
    df = spark.createDataFrame([(1, "a" * 900), (2, None), (3, "b")], "doc_id long, text string")
    assert spans.shared_spans(df).count() == 0 and spans.shared_spans(df.limit(0)).count() == 0
    shares = {r.doc_id: (r.n_chars, r.shared_chars, r.share) for r in spans.shared_shares(spark.createDataFrame([(1, "a" * 900), (2, None), (3, "a" * 900)], "doc_id long, text string")).collect()}
    assert shares == {1: (900, 900, 1.0), 2: (0, 0, 0.0), 3: (900, 900, 1.0)}
