"""Noise in text from scanned pages (problem 3).

The vocabulary is what the corpus says most often, in a trie. Every different word
of the corpus is judged once, by its own count: a word that is rare beside a candidate which differs from it by
a known misreading is a misread word. The candidates are all words of the trie that a Levenshtein automaton
accepts whose edits are the confusions of scanners (of any length, one kind in a word, as often as it likes);
true words too rare for the trie meet their misreadings by a key that confusions don't change. Confusions of several kinds in one word
and one plain edit lead to true words as well (che and the, bay and by), so those candidates count only where both
neighbours of the word call for them. Candidates are ranked by frequency and by the word before. Page furniture is found by where it stands and that it comes again;
what is left is joined over hyphens and page breaks and reflowed to paragraphs.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.llm.lookalike import Unifier
from evenfold.session import cut

# What scanners misread, as the true string and the string read instead.
CONFUSIONS = [
    ("e", "c"), ("r", "f"), ("o", "0"), ("a", "o"), ("t", "f"), ("n", "ri"), ("s", "5"), ("i", "l"), ("d", "cl"), ("cl", "d"), ("l", "1"),
    ("i", "1"), ("g", "q"), ("m", "rn"), ("rn", "m"), ("u", "ii"), ("h", "b"), ("b", "6"), ("w", "vv"), ("g", "9"), ("z", "2"), ("b", "8"),
    ("и", "н"), ("п", "н"), ("в", "8"), ("о", "0"), ("з", "3"), ("б", "6"), ("л", "п"), ("ш", "щ"), ("ц", "ч"),
]
#: Letters read instead of digits.
DIGITS = dict(zip("bBlIZzOoSsgqоОЗ", "681122005599003", strict=True))
#: By digit, the letters that are read as it, and the capitals of codes.
_READ_AS = {n: [true for true, read in CONFUSIONS if read == n] for n in "0123456789"}
_CODE_LETTERS = {n: c for c, n in DIGITS.items() if "A" <= c <= "Z"}
MARKS = "~^*|#"
#: How pages are labelled.
LABELS = {"page", "p", "pag", "pagina", "foglio", "f", "seite", "s", "blatt", "sheet", "стр", "лист", "с", "страница"}
#: A word of the vocabulary makes up this share of all words at least, so there are at most 500,000 of them; and MIN_COUNT.
SHARE, MIN_COUNT = 2e-6, 3
#: A misread word is rarer than the true one by this factor.
RARER = 6
#: Pairs of neighbours that are kept for ranking make up this share of all words at least: at most 200,000.
PAIR_SHARE = 5e-6
#: Verdicts on words go along with the code up to this many; more are joined to the texts that hold the words, to the same result.
MAX_VERDICTS = 300_000

_D = r"[\dbBlIZOoSs]"
_LABEL = re.compile(rf"^(?:[-–]\s*({_D}{{1,4}})\s*[-–]|\[({_D}{{1,4}})/{_D}{{1,4}}\]|([^\W\d_]{{1,8}})\.?\s*({_D}{{1,4}})(?:\s*(?:/|[^\W\d_]{{2,4}})\s*{_D}{{1,4}})?)$")
_PAGE_PART = re.compile(rf"^\s*{_D}{{1,4}}\s{{2,}}|\s{{2,}}{_D}{{1,4}}\s*$")
_PLAIN_NUMBER = re.compile(r"^[\d.,:/-]+$")
_BARE = re.compile(r"^\d{1,4}$")
_ROMAN = re.compile(r"(?=.)c{0,3}(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})$")
_BROKEN = re.compile(r"([^\W_]+)[-¬=]\s*\Z")
_CODE = re.compile(r"^([A-Za-z0-9]{2})-(?=[^\d]*\d)([0-9bBlLIiZzOoSs]{5})$")
_PART = re.compile(rf"[^\W_]+(?:[{re.escape(MARKS)}]+[^\W_]+)*")
_JOINED = re.compile(r"([^\W\d_])[-¬=][ \t]*\n(?=[^\W\d_A-ZА-Я])")
#: A line of fields or columns: a label at its start, bars that stand off (others are marks), or wide gaps; and signs between several fields.
_FIELDS = re.compile(r"\W*\d?[^\W\d][^:;|]{0,30}: \S|.*(?:\s{3,}|\s\|| = )")
_ENDS = (".", "!", "?", ":", ";")
_SEVERAL = re.compile(r"[;=]|\s\||\s{3,}")
_EDGE = ".,;:()[]{}\"'«»„“”!?&%><=+"


#: Letters and digits that are misread for each other, by class, as the string that stands for all of them; a letter that is misread
#: as two has the string of those two.
_FOLD = {ord(c): to for members, to in (
    ("0оаoa", "o"), ("eсc", "e"), ("1li", "i"), ("5s", "s"), ("gq9", "g"), ("bh68вб", "b"), ("rft", "t"), ("инпл", "и"), ("3з", "з"), ("2z", "z"), ("шщ", "ш"), ("цч", "ц"),
    ("d", "ei"), ("n", "ti"), ("m", "tti"), ("w", "vv"), ("u", "ii"),
) for c in members}


_NO_MARKS = str.maketrans("", "", MARKS)
_GAPS = re.compile(r"[^\w]+")


@lru_cache(maxsize=1 << 14)
def fold(text: str) -> str:
    """A key that a line keeps when it is misread: misread strings and true ones fall together."""
    return _GAPS.sub(" ", text.lower().translate(_NO_MARKS)).translate(_FOLD)


def header_key(line: str) -> str:
    """The fold of a line without the page number before or after it; empty for a line that can't be a running header."""
    t = _PAGE_PART.sub("", line.replace("\f", " ").strip())
    return fold(t).strip() if sum(map(str.isalpha, t)) >= 4 else ""


def page_label(line: str) -> int | None:
    """The number of a line that holds nothing but a labelled page number, in 40 characters at most; None for others."""
    t = line.replace("\f", " ").strip()
    m = _LABEL.match(t) if len(t) <= 40 else None
    if not m or (m[3] and fold(m[3]) not in {fold(x) for x in LABELS}):
        return None
    return digits(m[1] or m[2] or m[4])


def digits(text: str) -> int | None:
    got = "".join(DIGITS.get(c, c) for c in text)
    return int(got) if got.isdigit() else None


_ROMAN_VALUE = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def roman(text: str) -> int | None:
    """The value of a Roman numeral in either case, below 400; None for other strings. Where it is none as it stands, l and 1 are taken for i."""
    t = text.lower()
    if not t or not set(t) <= {*"ivxlc1"}:
        return None
    for t in (t, t.replace("1", "i"), re.sub("[l1]", "i", t)):
        if _ROMAN.match(t):
            v = [_ROMAN_VALUE[c] for c in t]
            return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True))
    return None


def bare_number(line: str) -> tuple[str, int] | None:
    """(sort, value) of a line that is one number: 9 for digits, i for a Roman numeral."""
    t = line.replace("\f", " ").strip()
    if _BARE.match(t):
        return "9", int(t)
    got = roman(t) if len(t) <= 8 else None
    return None if got is None else ("i", got)


def furniture(lines: list[str]) -> dict[int, str]:
    """Kinds (header, page_number) by line of one text of several pages. Labelled numbers are page numbers. Bare numbers, of digits or Roman, are if
    they go on by one from page to page, or stand alone at the text's top or foot. Headers stand next to a page break or at the text's top or foot and come again at another such place, perhaps
    with other numbers or misread; a text without page breaks has those lines that come again word for word, five lines apart or more."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    place = {i: k for k, i in enumerate(full)}
    out = {i: "page_number" for i in full if page_label(lines[i]) is not None}
    if not out:
        sorts: dict[str, list[tuple[int, int]]] = {"9": [], "i": []}
        for i in full:
            if got := bare_number(lines[i]):
                sorts[got[0]].append((i, got[1]))
        chain = max((_chain(some) for some in sorts.values()), key=len)
        alone = [i for some in sorts.values() for i, _ in some if i in (full[0], full[-1])]
        out = dict.fromkeys(chain if len(chain) > 1 else alone[:1], "page_number")
    near: dict[str, set[int]] = defaultdict(set)
    breaks = sorted({place[i] for i in out} | {place[i] for i in full if "\f" in lines[i]})
    edges = {k for b in breaks for k in (b - 1, b, b + 1) if 0 <= k < len(full)} | ({0, len(full) - 1} if breaks else set())
    for k in edges:
        if full[k] not in out and (key := header_key(lines[full[k]])):
            near[key].add(full[k])
    keys = {key for key, at in near.items() if len(at) > 1}
    if not breaks:
        again: dict[str, list[int]] = defaultdict(list)
        for i in full:
            if key := header_key(lines[i]):
                again[key].append(i)
        keys = {key for key, at in again.items() if len(at) > 1 and min(b - a for a, b in zip(at, at[1:], strict=False)) >= 5}
    if keys:
        # a misread line is as long as the true one but for a few letters
        sizes = [len(lines[i].strip()) for at in ((near[k] for k in keys) if breaks else (again[k] for k in keys)) for i in at]
        low, high = min(sizes) - 12, max(sizes) + 12
        out |= {i: "header" for i in full if i not in out and low <= len(lines[i].strip()) <= high and header_key(lines[i]) in keys}
    return out


def _chain(bare: list[tuple[int, int]]) -> list[int]:
    """Lines of the longest run of numbers that go on by one, other numbers between them passed over; of equally long ones the first."""
    ends: dict[int, tuple[int, int, int]] = {}  # by last number: length, less its first place, its last place
    back: list[int | None] = []
    best = (0, 0, -1)
    for k, (_, m) in enumerate(bare):
        size, first, before = ends.get(m - 1, (0, -k, None))
        back.append(before)
        if (size + 1, first) > ends.get(m, (0, 0))[:2]:
            ends[m] = (size + 1, first, k)
        best = max(best, (size + 1, first, k), key=lambda x: x[:2])
    at, k = [], best[2] if bare else None
    while k is not None:
        at.append(bare[k][0])
        k = back[k]
    return at[::-1]


class Trie:
    """The vocabulary by letters; the key "" of a node holds its word's count."""

    def __init__(self, counts: dict[str, int]):
        self.counts, self.root = counts, {}
        for word, n in counts.items():
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = n

    def candidates(self, word: str, plain: bool = False, mixed: bool = False) -> dict[str, tuple[int, ...]]:
        """All words whose misreading can be this one, with the places of the word that were misread: one kind of confusion, once or more
        often. With plain, also those one letter away, added, lost or other; with mixed, also confusions of several kinds."""
        found: dict[str, tuple[int, ...]] = {}
        n = len(word)
        todo: list[tuple[dict, int, int, str, tuple[int, ...]]] = [(self.root, 0, -1, "", ())]
        while todo:
            node, i, used, true, at = todo.pop()
            if i == n:
                if at and "" in node and (true not in found or len(at) < len(found[true])):
                    found[true] = at
            elif word[i] in node:
                todo.append((node[word[i]], i + 1, used, true + word[i], at))
            if i < n:
                for k in _STARTS.get(word[i], ()):
                    right, read = CONFUSIONS[k]
                    if (used in (-1, k) or (mixed and used >= 0)) and word.startswith(read, i):
                        to = node
                        for c in right:
                            to = to.get(c)
                            if to is None:
                                break
                        else:
                            todo.append((to, i + len(read), k, true + right, (*at, *range(i, i + len(read)))))
            if plain and used == -1:
                spot = (min(i, n - 1),)
                if i < n:
                    todo.append((node, i + 1, -2, true, spot))
                for c, to in node.items():
                    if c:
                        todo.append((to, i, -2, true + c, spot))
                        if i < n and c != word[i]:
                            todo.append((to, i + 1, -2, true + c, spot))
        return found


_STARTS: dict[str, list[int]] = defaultdict(list)
for _k, (_true, _read) in enumerate(CONFUSIONS):
    _STARTS[_read[0]].append(_k)


Rival = tuple[str, tuple[int, ...], int]
#: A word's count, its rivals by one kind of confusion, and, if it has none, those by several kinds or one plain edit.
Verdict = tuple[int, list[Rival], list[Rival]]


class Reader:
    """Tells misread words and corrects them. counts: the vocabulary; pairs: counts of neighbours; least: the count below which a word is not in the
    vocabulary. verdicts: what is known of all words of the corpus, those without rivals left out; None if words are to be judged here."""

    def __init__(self, counts: dict[str, int], pairs: dict[tuple[str, str], int], least: int, verdicts: dict[str, Verdict] | None = None):
        self.counts, self.pairs, self.least, self.verdicts = counts, pairs, least, verdicts
        self._trie: Trie | None = None
        self._triples: Counter | None = None
        self.known: dict[tuple[str, bool], list[Rival]] = {}
        self.far: dict[tuple[str, bool], tuple[int, list[Rival]]] = {}
        self.unpaired = max(1, min(pairs.values(), default=MIN_COUNT) - 1)
        self.seen: dict[str, bool] = {}
        self.plain: dict[str, bool] = {}
        self.calm: dict[str, tuple[str, ...] | None] = {}

    @property
    def trie(self) -> Trie:
        if self._trie is None:
            self._trie = Trie(self.counts)
        return self._trie

    def use(self, verdicts: dict[str, Verdict]) -> None:
        """Takes other verdicts, for the next text."""
        self.verdicts = verdicts
        for cache in (self.known, self.far, self.seen, self.plain, self.calm):
            cache.clear()

    def judge(self, word: str, own: int) -> Verdict:
        """The verdict on a word of this count, by the vocabulary. Codes of letters and digits have no far rivals, for a code one sign away is another code."""
        some = lambda found: sorted(((true, at, n) for true, at in found.items() if (n := self.counts[true]) >= RARER * own), key=lambda r: (-r[2], r[0]))
        near = some(self.trie.candidates(word))
        far = some(self.trie.candidates(word, plain=True, mixed=True)) if not near and sum(map(str.isalpha, word)) > 2 and not any(c in MARKS for c in word) else []
        return own, near, far

    def verdict(self, word: str, anew: bool = False) -> Verdict:
        """anew: the word needn't be one of the corpus' (two parts of lines put together) and is judged by the vocabulary, as a word of it or one that stands once."""
        if self.verdicts is None or anew:
            return self.judge(word, self.counts.get(word, 1))
        return self.verdicts.get(word) or (self.counts.get(word, 1), [], [])

    def rivals(self, word: str, anew: bool = False) -> list[Rival]:
        """(true word, misread places, count) of a folded word that is misread, most frequent first; empty if it isn't."""
        got = self.known.get((word, anew))
        if got is None:
            clean = re.sub(f"[{re.escape(MARKS)}]", "", word)
            if clean != word:
                spots = tuple(i for i, c in enumerate(word) if c in MARKS)
                got = [(clean, spots, self.counts.get(clean, 0))]
            else:
                got = self.verdict(word, anew)[1]
            if not got and any(map(str.isdigit, word)) and sum(map(str.isalpha, word)) >= 3 and word not in self.counts:
                # a digit inside a word that no candidate explains (a rare name): its letters tell enough
                spots = tuple(i for i, c in enumerate(word) if c.isdigit())
                if re.fullmatch(r"\d?[^\W\d_]+(?:\d{1,2}[^\W\d_]+)*\d?", word) and len(spots) <= len(word) // 2:
                    got = [(word, spots, 0)]
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word, anew] = got
        return got

    def wider(self, word: str, anew: bool = False) -> list[Rival]:
        """As rivals(), for a word that has none: the words at confusions of several kinds or one plain edit, most frequent first."""
        got = self.far.get((word, anew))
        if got is None:
            own, _, far = self.verdict(word, anew) if not self.rivals(word, anew) else (0, [], [])
            got = own, far
            if len(self.far) > 300_000:
                self.far.clear()
            self.far[word, anew] = got
        return got[1]

    def fitting(self, before: str, word: str, after: str, anew: bool = False) -> Rival | None:
        """Of wider(), the word that both neighbours have beside them RARER times as often as this one, and most often; None if there is none."""
        if not before or not after:
            return None
        far = self.wider(word, anew)
        most = min(self.unpaired, self.far[word, anew][0])  # of a pair that isn't kept
        own = (RARER * self.pairs.get((before, word), most), RARER * self.pairs.get((word, after), most))
        beside = [(self.pairs.get((before, r[0]), 0), self.pairs.get((r[0], after), 0), r) for r in far]
        fit = [(min(a, b), r) for a, b, r in beside if a >= own[0] and b >= own[1]]
        return max(fit, key=lambda x: (x[0], x[1][2]))[1] if fit else None

    def misread(self, token: str) -> bool:
        """Whether a token holds a misread word or is a misread number or code."""
        got = self.seen.get(token)
        if got is None:
            number = self.number(token)
            got = number if number is not None else any(len(p) > 2 and not p.isdigit() and self.rivals(p) for p in map(str.lower, _PART.findall(token)))
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[token] = got = bool(got)
        return got

    def clean(self, line: str) -> bool:
        """Whether nothing in a line could be misread, whatever stands beside it: no token is, and no word has wider rivals."""
        for raw in line.split():
            got = self.plain.get(raw)
            if got is None:
                token = raw.strip(_EDGE)
                got = not (token and self.misread(token)) and not any(self.wider(w) for w in parts_of(raw))
                if len(self.plain) > 300_000:
                    self.plain.clear()
                self.plain[raw] = got
            if not got:
                return False
        return True

    def settled(self, raw: str) -> tuple[str, ...] | None:
        """The folded words of a token that stays as it is, whatever stands beside it; None for others."""
        if raw not in self.calm:
            core = raw.strip(_EDGE)
            words = tuple(map(str.lower, _PART.findall(core)))
            if len(self.calm) > 300_000:
                self.calm.clear()
            self.calm[raw] = None if (core and self.number(core)) or any((len(w) > 2 and self.rivals(w)) or self.wider(w) for w in words) else words
        return self.calm[raw]

    def best(self, word: str, before: str, anew: bool = False) -> str:
        """The true word: the rival that follows the word before most often, then the most frequent one."""
        true, spots, _ = max(self.rivals(word, anew), key=lambda r: (self.pairs.get((before, r[0]), 0), r[2]))
        return self.lettered(word, spots) if true == word else true

    def lettered(self, word: str, spots: tuple[int, ...]) -> str:
        """A word that no candidate explains, with letters of its own script for its digits: of several, the one that stands so in most words of the vocabulary."""
        cyrillic = any("а" <= c <= "я" for c in word)
        for i in spots:
            some = [c for c in _READ_AS.get(word[i], ()) if ("а" <= c <= "я") == cyrillic]
            if len(some) > 1:
                if self._triples is None:
                    self._triples = Counter(w[j : j + 3] for w in (f" {v} " for v in self.counts) for j in range(len(w) - 2))
                around = f" {word} "
                some.sort(key=lambda c: -self._triples[around[i] + c + around[i + 2]])  # noqa: B023
            if some:
                word = word[:i] + some[0] + word[i + 1 :]
        return word

    def number(self, token: str) -> bool | None:
        """Whether a number or code is misread; None for what is neither."""
        if m := _CODE.match(token):
            return (any(map(str.isdigit, m[1])) and not m[1].isdigit()) or not m[2].isdigit()
        if not any(map(str.isdigit, token)):
            return None
        bare = re.sub(f"[{re.escape(MARKS)}]", "", token)
        if re.fullmatch(r"[\d.,:/-]+", bare):
            return bare != token
        if re.fullmatch(r"[A-ZА-Я]\d{1,3}", token):
            return False
        if all(c.isdigit() or c in ".,:/-" or c in DIGITS for c in bare) and sum(map(str.isdigit, bare)) * 2 >= sum(map(str.isalnum, bare)):
            if not re.fullmatch(r"(?:\d+[.,:/-])*\d+", "".join(DIGITS.get(c, c) for c in bare)):
                return None
            return None if bare.lower() in self.counts and bare == token else True
        return None


def tokens(line: str) -> list[str]:
    return [t for w in line.split() if (t := w.strip(_EDGE))]


@lru_cache(maxsize=200_000)
def parts_of(token: str) -> tuple[str, ...]:
    """Folded words of a token; none for numbers and codes."""
    token = token.strip(_EDGE)
    if not token or _PLAIN_NUMBER.match(token) or _CODE.match(token):
        return ()
    return tuple(p.lower() for p in _PART.findall(token))


def words_in(line: str) -> list[str]:
    """Folded words of a line; numbers and codes aside."""
    return [p for t in line.split() for p in parts_of(t)]


def _break(line: str) -> re.Match | None:
    """The word, or its beginning, before a mark of hyphenation at a line's end."""
    return _BROKEN.search(line) if line.rstrip()[-1:] in ("-", "¬", "=") else None


def broken(line: str, following: str | None) -> bool:
    """Whether the line ends within a word that the following line of running text goes on with."""
    m = _break(line)
    if not m or not m[1][-1].isalpha() or following is None:
        return False
    start = following.replace("\f", " ").lstrip()
    return start[:1].islower() or (start[:1].isdigit() and start[1:2].islower())


def running(lines: list[str], kinds: dict[int, str]) -> list[int]:
    """The lines of running text, without furniture and empty ones."""
    return [i for i, x in enumerate(lines) if x.strip() and i not in kinds]


def follower(lines: list[str], body: list[int], k: int) -> int | None:
    """The line that goes on after the k-th of the body; rereadings of the same line are passed over."""
    own = fold(lines[body[k]])
    for j in body[k + 1 :]:
        if fold(lines[j]) != own:
            return j
    return None


def _beside(lines: list[str], body: list[int], k: int, step: int) -> str:
    """The word of running text next to the k-th line of the body, before (-1) or after it (1); rereadings of the line are passed over.
    Empty if there is none or it is broken."""
    own = fold(lines[body[k]])
    while 0 <= (k := k + step) < len(body):
        line = lines[body[k]]
        if fold(line) != own:
            got = words_in(line)
            return got[min(step, 0)] if got and not (_break(line) and (step < 0 or len(got) < 2)) else ""
    return ""


def ill_fitting(lines: list[str], i: int, body: list[int], place: dict[int, int], joined: dict[int, str], reader: Reader) -> bool:
    """Whether a line has a word that both its neighbours call another. joined: by line, the whole word that it begins (at its end) and, by
    ~line, the one that it goes on with; these two are neighbours here and no more."""
    got = words_in(lines[i])
    first, last = int(~i in joined), len(got) - (i in joined)
    for n in range(first, last):
        if reader.wider(got[n]):
            before = got[n - 1] if n > first else joined[~i] if first else _beside(lines, body, place[i], -1) if i in place else ""
            after = got[n + 1] if n + 1 < last else joined[i] if i in joined else _beside(lines, body, place[i], 1) if i in place else ""
            if reader.fitting(before, got[n], after):
                return True
    return False


def misread_lines(lines: list[str], kinds: dict[int, str], reader: Reader, ends: bool, open_start: bool) -> set[int]:
    """Lines with a misread word or number. Words broken over two lines are read as one, and each line counts for the places in
    its own part. ends: the last word may be cut off; open_start: the first word may go on from a page before."""
    out: set[int] = set()
    body = running(lines, kinds)
    skip: set[int] = set()
    joined: dict[int, str] = {}
    for k, i in enumerate(body):
        m = _break(lines[i])
        if not m:
            continue
        j = follower(lines, body, k)
        if not broken(lines[i], lines[j] if j is not None else None):
            if j is None and m[1][-1].isalpha():
                skip.add(i)
            continue
        a, b = m[1].lower(), (_PART.search(lines[j]) or [""])[0].lower()
        # the part on the next line may hold a mark, the part on this one too
        whole = (_last_part(lines[i]) or a) + b
        head = len(whole) - len(b)
        if rivals := reader.rivals(whole, anew=True):
            spots = max(rivals, key=lambda r: r[2])[1]
            out |= {i for s in spots if s < head} | {j for s in spots if s >= head}
        elif reader.wider(whole, anew=True) and (true := reader.fitting((["", *words_in(lines[i])[:-1]])[-1], whole, ([*words_in(lines[j])[1:], ""])[0], anew=True)):
            out |= {i if s < head else j for s in true[1]}
        skip |= {i, ~j}
        joined |= {i: whole, ~j: whole}
    full = [x for x in range(len(lines)) if lines[x].strip()]
    place = {i: k for k, i in enumerate(body)}
    for i in full:
        if kinds.get(i) == "page_number":
            toks = tokens(lines[i])
            if any(c in DIGITS and c not in "sS" for t in toks if not t.isalpha() for c in t) or (len(toks) == 1 and not toks[0].isdigit() and roman(toks[0]) and not _ROMAN.match(toks[0].lower())):
                out.add(i)
            continue
        if i not in skip and ~i not in skip and reader.clean(lines[i]):
            continue
        toks = tokens(lines[i])
        if i in skip:
            toks = toks[:-1]
        elif ends and body and i == body[-1] and lines[i].rstrip()[-1:].isalnum():
            toks = toks[:-1]  # the text may be cut off within its last word
        if ~i in skip and toks:  # its first word has been read with the line before
            rest = [p.lower() for p in _PART.findall(toks[0])[1:]]
            if any(len(p) > 2 and not p.isdigit() and reader.rivals(p) for p in rest):
                out.add(i)
            toks = toks[1:]
        elif open_start and i == full[0] and toks and toks[0][:1].islower() and toks[0].lower() not in reader.counts:
            toks = toks[1:]
        if any(map(reader.misread, toks)) or ill_fitting(lines, i, body, place, joined, reader):
            out.add(i)
    return out


def _last_part(line: str) -> str:
    found = _PART.findall(line.rstrip().rstrip("-¬="))
    return found[-1].lower() if found else ""


_SEEN = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch], context: bool = True) -> Iterator[pa.RecordBatch]:
    """Counts of words (b empty) and, for the context, of neighbours in a line, with words broken over lines joined."""
    u = Unifier()
    for batch in batches:
        words, pairs, said = Counter(), Counter(), []
        # one string per batch; the empty lines between keep a text from going on in the next one
        whole = "\n\n".join(t if t.isascii() else u.unmixed(t) for t in batch.column(0).to_pylist())
        for line in _JOINED.sub(r"\1", whole).split("\n"):
            got = words_in(line)
            if got and _break(line):
                got.pop()
            said += got
            if context:
                pairs.update(zip(got, got[1:], strict=False))
        words.update(said)
        rows = [(w, "", n) for w, n in words.items()] + [(a, b, n) for (a, b), n in pairs.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SEEN)], schema=_SEEN)


_VERDICT = "word string, own long, near array<struct<true: string, at: array<int>, n: long>>, far array<struct<true: string, at: array<int>, n: long>>"
_RIVALS = pa.list_(pa.struct([("true", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.int64())]))
_VERDICT_PA = pa.schema([("word", pa.string()), ("own", pa.int64()), ("near", _RIVALS), ("far", _RIVALS)])


def _verdict_rows(rows: list[tuple[str, Verdict]]) -> pa.RecordBatch:
    listed = lambda rivals: [{"true": t, "at": list(at), "n": n} for t, at, n in rivals]
    cols = [[w for w, _ in rows], [v[0] for _, v in rows], [listed(v[1]) for _, v in rows], [listed(v[2]) for _, v in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _VERDICT_PA, strict=True)], schema=_VERDICT_PA)


def _verdict_of(row) -> Verdict:
    tuples = lambda rivals: [(r["true"], tuple(r["at"]), r["n"]) for r in rivals]
    return row["own"], tuples(row["near"]), tuples(row["far"])


def count_words(texts: DataFrame, context: bool = True) -> DataFrame:
    """(a, b, n): every word of the column text with its count (b empty), and neighbours that come MIN_COUNT times. Written once."""
    seen = texts.select("text").where("text is not null").mapInArrow(partial(_count, context=context), "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return cut(seen.where(f"b = '' or n >= {MIN_COUNT}"))


def vocabulary(seen: DataFrame) -> tuple[tuple[tuple[str, int], ...], tuple[tuple[str, str, int], ...], int]:
    """(words with counts, neighbours with counts, least count) of counted words. What is kept makes up a fixed share of all words, which bounds
    its number whatever the corpus' size; a word must come MIN_COUNT times at least."""
    total = seen.where("b = ''").agg(F.sum("n")).first()[0] or 0
    least = max(MIN_COUNT, int(total * SHARE))
    words = seen.where((F.col("b") == "") & (F.col("n") >= least)).collect()
    pairs = seen.where((F.col("b") != "") & (F.col("n") >= max(MIN_COUNT, int(total * PAIR_SHARE)))).collect()
    return tuple((r.a, r.n) for r in words), tuple((r.a, r.b, r.n) for r in pairs), least


class _Shipped:
    """What goes to the executors; each worker builds its reader once."""

    def __init__(self, key: str, words, pairs, least: int, verdicts=None):
        self.key, self.words, self.pairs, self.least, self.verdicts = key, words, pairs, least, verdicts


_READERS: dict[str, Reader] = {}


def _reader(bc) -> Reader:
    v = bc.value
    if v.key not in _READERS:
        _READERS.clear()
        _READERS[v.key] = Reader(dict(v.words), {(a, b): n for a, b, n in v.pairs}, v.least, None if v.verdicts is None else {w: (own, near, far) for w, own, near, far in v.verdicts})
    return _READERS[v.key]


def judged(seen: DataFrame, bc, least: int) -> DataFrame:
    """(word, own, near, far): the verdict on every different word of a corpus that has rivals. The vocabulary's words are found by the automaton; the
    rarer ones among which true words may be (RARER times and more) by fold(), which no confusion changes: words with one key
    meet, and an automaton over those alone decides."""
    words = seen.where("b = ''").select(F.col("a").alias("word"), F.col("n").alias("own"))

    def by_trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(bc)
        for batch in batches:
            rows = [(w, reader.judge(w, n)) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(w) > 2 and not w.isdigit()]
            yield _verdict_rows([(w, v) for w, v in rows if v[1] or v[2]])

    found = words.repartition(F.col("word")).mapInArrow(by_trie, _VERDICT)
    if least <= RARER:
        return cut(found)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([fold(w) for w in batch.column(0).to_pylist()], pa.string()), batch.column(0), batch.column(1)], names=["key", "word", "own"])

    def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for group in batch.column(0).to_pylist():
                true = {g["word"]: g["own"] for g in group if RARER <= g["own"] < least}
                trie = Trie(true) if true else None
                for g in group if trie else ():
                    if len(g["word"]) > 2 and (near := [(t, at, true[t]) for t, at in trie.candidates(g["word"]).items() if true[t] >= RARER * g["own"]]):
                        out.append((g["word"], (g["own"], near, [])))
            yield _verdict_rows(out)

    groups = words.mapInArrow(keyed, "key string, word string, own long").groupBy("key").agg(F.collect_list(F.struct("word", "own")).alias("g"))  # different words that confusions alone part
    rest = groups.where(F.size("g") > 1).select("g").mapInArrow(by_key, _VERDICT)
    near = F.array_sort(F.flatten(F.collect_list("near")), lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1)).otherwise(F.when(a["true"] < b["true"], -1).when(a["true"] > b["true"], 1).otherwise(0)))
    both = found.unionByName(rest).groupBy("word").agg(F.max("own").alias("own"), near.alias("near"), F.flatten(F.collect_list("far")).alias("far"))
    return cut(both.withColumn("far", F.when(F.size("near") > 0, F.slice("far", 1, 0)).otherwise(F.col("far"))))


class Judged:
    """A corpus' vocabulary, broadcast (500,000 words and 200,000 pairs at most), and its verdicts: broadcast along with it up to MAX_VERDICTS, else
    a table to be joined to the texts that hold the words."""

    def __init__(self, texts: DataFrame, context: bool = True):
        sc = texts.sparkSession.sparkContext
        seen = count_words(texts, context)
        words, pairs, least = vocabulary(seen)
        first = sc.broadcast(_Shipped(uuid.uuid4().hex, words, pairs, least))
        table = judged(seen, first, least)
        few = table.limit(MAX_VERDICTS + 1).collect()
        self.table = table if len(few) > MAX_VERDICTS else None
        verdicts = None if self.table is not None else tuple((r.word, *_verdict_of(r)) for r in few)
        self.bc = sc.broadcast(_Shipped(uuid.uuid4().hex, words, pairs, least, () if verdicts is None else verdicts))

    def with_verdicts(self, rows: DataFrame, text: Column) -> DataFrame:
        """rows with _verdicts, those on the words of a text (a string; null where they are broadcast). rows must come out the same when they are read again."""
        if self.table is None:
            return rows.withColumn("_verdicts", F.lit(None).cast(f"array<struct<{_VERDICT.replace(' ', ': ', 1).replace(', own ', ', own: ').replace(', near ', ', near: ').replace(', far ', ', far: ')}>>"))
        keyed = rows.withColumn("_row", F.xxhash64(text))

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [sorted({*words_in(_plain().unmixed(t).replace("\n", " "))}) if t else [] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["_row", "words"])

        own = keyed.select("_row", text.alias("t")).mapInArrow(spell, "_row long, words array<string>").select("_row", F.explode("words").alias("word")).distinct()
        own = own.join(self.table, "word").groupBy("_row").agg(F.collect_list(F.struct("word", "own", "near", "far")).alias("_verdicts"))  # of one text
        return keyed.join(own, "_row", "left").drop("_row")


def _with_own(reader: Reader, bc, own: list | None) -> Reader:
    """The reader with a text's own verdicts, where they aren't broadcast."""
    if bc.value.verdicts == ():
        reader.use({r["word"]: _verdict_of(r) for r in own or []})
    return reader


def ship(texts: DataFrame, context: bool = True) -> Judged:
    """The vocabulary and the verdicts of the texts. The pairs rank candidates; without them no word is misread by its neighbours."""
    return Judged(texts, context)


@lru_cache(maxsize=1)
def _plain() -> Unifier:
    return Unifier()


_FOUND = "record_id string, line_no int, kind string"
_FOUND_PA = pa.schema([("record_id", pa.string()), ("line_no", pa.int32()), ("kind", pa.string())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FOUND_PA)], schema=_FOUND_PA)


def noise_of(text: str, reader: Reader) -> list[tuple[int, str]]:
    """(line from 1, kind) of a text of several pages."""
    lines = _plain().unmixed(text).split("\n")
    kinds = furniture(lines)
    body = running(lines, kinds)
    out = [(i + 1, kind) for i, kind in kinds.items()]
    for k, i in enumerate(body):
        if _break(lines[i]):
            j = follower(lines, body, k)
            if broken(lines[i], lines[j] if j is not None else None):
                out.append((i + 1, "hyphen"))
    return out + [(i + 1, "misread") for i in misread_lines(lines, kinds, reader, ends=True, open_start=False)]


def text_noise(texts: DataFrame, known: Judged) -> DataFrame:
    """(record_id, line_no, kind) from whole texts (record_id, text), each once. Null texts have no lines."""
    bc = known.bc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(bc)
        for batch in batches:
            yield _rows([(rid, n, kind) for rid, text, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for n, kind in noise_of(text, _with_own(reader, bc, own))])

    rows = texts.select("record_id", "text").where("record_id is not null and text is not null")
    return known.with_verdicts(rows, F.col("text")).select("record_id", "text", "_verdicts").mapInArrow(run, _FOUND).distinct()


def line_furniture(lines: DataFrame) -> DataFrame:
    """(line_id, kind) of lines (line_id, group_id, variant, page, line, text) whose pages are known. Only the two uppermost and the two lowest lines
    of a page are looked at; a header comes again on another page of the document, in whatever reading. Bare
    numbers count in documents without labelled ones, if they are as far from the page's number as on the document's other pages."""
    edge = lines.groupBy("group_id", "variant", "page").agg(F.array_sort(F.collect_set("line")).alias("l"))  # of one page
    edge = edge.select("group_id", "variant", "page", F.slice("l", 1, 2).alias("top"), F.slice("l", -2, 2).alias("foot"), F.size("l").alias("n"))
    edge = edge.withColumn("foot", F.when(F.col("n") > 1, F.col("foot")).otherwise(F.col("top")))
    at = lines.join(edge, ["group_id", "variant", "page"]).where(F.array_contains("top", F.col("line")) | F.array_contains("foot", F.col("line")))
    kind = "line_id long, group_id string, page int, key string, label boolean, off int"
    schema = pa.schema([("line_id", pa.int64()), ("group_id", pa.string()), ("page", pa.int32()), ("key", pa.string()), ("label", pa.bool_()), ("off", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for line_id, group, page, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = _plain().unmixed(text)
                bare = bare_number(text)
                out.append((line_id, group, page, header_key(text), page_label(text) is not None, None if bare is None else bare[1] - page))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)

    seen = cut(at.select("line_id", "group_id", "page", "text").mapInArrow(run, kind))
    again = seen.where("key <> '' and not label").groupBy("group_id", "key").agg(F.count_distinct("page").alias("n")).where("n > 1").select("group_id", "key", F.lit(True).alias("header"))
    usual = seen.where("off is not null").groupBy("group_id", "off").agg(F.count_distinct("page").alias("n"))
    usual = usual.groupBy("group_id").agg(F.max_by("off", F.struct("n", -F.abs("off"))).alias("usual"), F.max("n").alias("times"))
    sort = seen.groupBy("group_id").agg(F.max("label").alias("labelled"), F.count_distinct("page").alias("n_pages"))
    usual = usual.join(sort, "group_id").where("not labelled and (times > 1 or usual = 0 or n_pages = 1)").select("group_id", "usual")
    out = seen.join(again, ["group_id", "key"], "left").join(usual, "group_id", "left")
    kind_of = F.when(F.col("label") | (F.col("off") == F.col("usual")), "page_number").when(F.col("header"), "header")
    return out.select("line_id", kind_of.alias("kind")).where("kind is not null").distinct()


def _whole(rows: DataFrame) -> DataFrame:
    """The rows whose place and text are known, as line_furniture() wants them."""
    return rows.na.drop(subset=["line_id", "page", "line", "text"]).withColumns({c: F.coalesce(c, F.lit("")) for c in ("group_id", "variant")})


def _line_rows(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("line_id").cast("long"), "group_id", "variant", F.col("page").cast("int"), F.col("line").cast("int"), "text")


def line_noise(lines: DataFrame, known: Judged) -> DataFrame:
    """(record_id, line_no, kind) from lines (line_id, group_id, variant, page, line, text). A page is one unit of work; a word at
    its end counts as broken if the reading has a later page. Rows without line_id, page, line or text are left out."""
    rows = _whole(_line_rows(lines))
    last = rows.groupBy("group_id", "variant").agg(F.max("page").alias("last"))
    kinds = line_furniture(rows)
    flagged = rows.join(kinds, "line_id", "left")
    pages = flagged.groupBy("group_id", "variant", "page").agg(F.array_sort(F.collect_list(F.struct("line", "line_id", "text", "kind"))).alias("lines"))  # of one page
    pages = pages.join(last, ["group_id", "variant"]).select("lines", (F.col("page") < F.col("last")).alias("more"), (F.col("page") > 1).alias("later"))
    pages = known.with_verdicts(pages, F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).select("lines", "more", "later", "_verdicts")
    bc = known.bc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(bc)
        for batch in batches:
            out = []
            for got, more, later, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                _with_own(reader, bc, own)
                lines = [_plain().unmixed(r["text"]) for r in got]
                kinds = {i: r["kind"] for i, r in enumerate(got) if r["kind"]}
                name = lambda i: (str(got[i]["line_id"]), got[i]["line"])  # noqa: B023, E731
                out += [(*name(i), kind) for i, kind in kinds.items()]
                body = running(lines, kinds)
                for k, i in enumerate(body):
                    if not _break(lines[i]):
                        continue
                    j = follower(lines, body, k)
                    if broken(lines[i], lines[j] if j is not None else "x" if more else None):
                        out.append((*name(i), "hyphen"))
                out += [(*name(i), "misread") for i in misread_lines(lines, kinds, reader, ends=False, open_start=later)]
            yield _rows(out)

    return pages.mapInArrow(run, _FOUND).distinct()


def repair_text(text: str, reader: Reader) -> str:
    """The text as paragraphs: furniture dropped, broken words joined, misread words replaced by the best candidate, lines of running
    text joined. A blank line, a line much shorter than the widest of running text and a line of fields end a paragraph."""
    lines = _plain().unmixed(text).split("\n")
    return repair_lines(lines, furniture(lines), reader)


def repair_lines(lines: list[str], kinds: dict[int, str], reader: Reader) -> str:
    """As repair_text(), for the lines of a text whose furniture is known. Rereadings of a line that ends within a word are dropped, as the word goes on after them."""
    body = running(lines, kinds)
    wide = max((len(t) for i in body if not _FIELDS.match(t := lines[i].strip())), default=0)
    paragraphs: list[str] = []
    glue, joined, last, began = False, set(), -1, -1
    for k, i in enumerate(body):
        if glue and fold(lines[i]) == fold(lines[last]):
            continue
        line = lines[i].replace("\f", " ").strip()
        j = follower(lines, body, k) if _break(lines[i]) else None
        joins = broken(lines[i], lines[j] if j is not None else None)
        if joins:
            line = re.sub(r"[-¬=]\s*$", "", line)
        gap = k > 0 and not glue and any(not lines[x].strip() for x in range(last + 1, i)) and not any(x in kinds for x in range(last + 1, i))
        previous = lines[last].strip() if k else ""
        short = not previous or len(previous) < 0.7 * wide
        # a sentence goes on in small letters, also one with a colon or with a line of a number between; a line read again in small letters doesn't
        open_end = _BARE.match(previous) and began != last or not _SEVERAL.search(previous) and (not short or not (_FIELDS.match(previous) or previous.endswith(_ENDS)))
        goes_on = open_end and line[:1].islower() and not _FIELDS.match(line) and fold(line).strip() != fold(previous).strip()
        stops = gap or (not goes_on and (short or bool(_FIELDS.match(previous) or _FIELDS.match(line))))
        if k == 0 or (stops and not glue):
            paragraphs.append(line)
            began = i
        else:
            if glue:
                joined.add(((_PART.findall(paragraphs[-1]) or [""])[-1] + (_PART.search(line) or [""])[0]).lower())
            paragraphs[-1] += line if glue else " " + line
        glue, last = joins, i
    return "\n\n".join(_respell(p, reader, joined) for p in paragraphs)


def _word_from(text: str, at: int) -> str:
    """The first word of a text from a place on; numbers and codes are passed over."""
    return next((got[0] for m in re.compile(r"\S+").finditer(text, at) if (got := parts_of(m.group()))), "")


def _respell(paragraph: str, reader: Reader, joined: set[str]) -> str:
    """The paragraph with its misread words and numbers corrected. joined: words that were put together from two lines."""
    out, at, before = [], 0, ""
    for m in re.finditer(r"\S+", paragraph):
        words = reader.settled(m.group())
        if words is not None and joined.isdisjoint(words):
            before = words[-1] if words else before
            continue
        core = m.group().strip(_EDGE)
        start = m.start() + m.group().find(core) if core else m.start()
        if core and reader.number(core):
            if _CODE.match(core):
                lead = core[:2] if core[:2].isdigit() else "".join(_CODE_LETTERS.get(c, c) for c in core[:2])
                new = lead + "-" + "".join(DIGITS.get(c, c) for c in core[3:])
            else:
                new = "".join(DIGITS.get(c, c) for c in core if c not in MARKS)
            out += [paragraph[at:start], new]
            at = start + len(core)
        elif core:
            for p in _PART.finditer(paragraph, start, start + len(core)):
                word = p.group().lower()
                anew = word in joined
                if len(word) > 2 and reader.rivals(word, anew):
                    true = reader.best(word, before, anew)
                elif reader.wider(word, anew) and (fit := reader.fitting(before, word, _word_from(paragraph, p.end()), anew)):
                    true = fit[0]
                else:
                    true = ""
                if true:
                    new = true.upper() if p.group().isupper() and len(true) > 1 else true.capitalize() if p.group()[:1].isupper() else true
                    out += [paragraph[at : p.start()], new]
                    at, word = p.end(), new.lower()
                before = word
    return "".join(out) + paragraph[at:]


def repair(texts: DataFrame, known: Judged) -> DataFrame:
    """(record_id, text) with texts in continuous paragraphs; a null text stays null."""
    bc = known.bc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(bc)
        for batch in batches:
            new = [None if t is None else repair_text(t, _with_own(reader, bc, own)) for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["record_id", "text"])

    return known.with_verdicts(texts.select("record_id", "text"), F.col("text")).select("record_id", "text", "_verdicts").mapInArrow(run, "record_id string, text string")


_READING = "group_id string, variant string, text string"


def repair_lines_of(got: list, reader: Reader) -> str | None:
    """The paragraphs of one reading's lines (page, line, line_id, text, kind) in order; null if it has none. Rows that repeat a line word for word at its place count once."""
    lines, kinds, at = [], {}, {}
    for r in got:
        i = at.setdefault((r["page"], r["line"], r["text"]), len(lines))
        if i == len(lines):
            lines.append(_plain().unmixed(r["text"]).replace("\n", " "))
        if r["kind"]:
            kinds[i] = r["kind"]
    return repair_lines(lines, kinds, reader) if lines else None


def repair_readings(lines: DataFrame, known: Judged) -> DataFrame:
    """(group_id, variant, text): the lines (line_id, group_id, variant, page, line, text) of each reading of a document in continuous paragraphs over all its
    pages, one row for each group_id and variant. A line without page or line stands at the end of its reading or page; a reading of null texts alone has a null text."""
    rows = _line_rows(lines)
    end = lambda c: F.coalesce(c, F.lit(2**31 - 1)).alias(c)
    flagged = rows.join(line_furniture(_whole(rows)), "line_id", "left")
    texts = flagged.groupBy("group_id", "variant").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct(end("page"), end("line"), "line_id", "text", "kind")))).alias("lines"))  # of one reading
    texts = known.with_verdicts(texts, F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).select("group_id", "variant", "lines", "_verdicts")
    bc = known.bc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(bc)
        for batch in batches:
            new = [repair_lines_of(got, _with_own(reader, bc, own)) for got, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.string())], names=["group_id", "variant", "text"])

    return texts.mapInArrow(run, _READING)
