"""Evaluation items that leak into pages, by template canonicalisation.

Words of items and pages become a template: numbers turn into ``#``, units
behind a number into ``%``, names (words that no item writes in small letters)
into ``@``; all other words stay.  Windows of three canonical words are hashed
into a template key, and the values of their slots into a slot key.  Pages and
items are joined on both, which is the hash join of template windows with its
slots checked for consistency at once: a question with other numbers or names
in the same template has other slot keys and is no candidate, and a template
that a third of all items share is split by its values.  Windows without slots
count only where an item has a whole passage without any.

Every candidate pair is then compared word by word from the windows that agree.
A slot may differ only as a misreading can (the same letters or digits to a
scanner); anything else ends the run there.  Other words may be misread, split
or merged.  Adverts of up to ``MAX_INSERT`` words may stand between two words
of a passage.  An item counts as leaked from ``MIN_WORDS`` consecutive words
on, counted over the item's words.

One Arrow pass reads the pages; a bit map of fixed size (``FILTER_BITS``) keeps
windows that no item has out of the join.  Pages without any such window go no
further, items are never collected, and the corpus is read once however many
items there are.  The vocabulary that tells names from template words holds at
most ``VOCABULARY`` words, those in most items; it decides the split into
template and slots only, never what a match is.

Defined results: NULL and blank texts leak nothing; items of fewer than
``MIN_WORDS`` words or without text cannot leak; repeated pages each count;
items repeated under one id count once.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.llm.pages import boxes, fold, joined, reading_order
from astrolith.runtime import Scratch, workers_can_import

MIN_WORDS = 15
#: page words that may stand between two neighbouring words of a passage: an advert of several lines
MAX_INSERT = 60
#: least likeness of letters of a misread word, of one cut or put together, and share of slots that
#: must hold but for letters that scanners confuse
LIKE, LIKE_CUT, SLOTS = 0.55, 0.75, 0.6
#: bound of the vocabulary, and bits of the filter in front of the join
VOCABULARY = 200_000
FILTER_BITS = 1 << 26

# Units of measure and time in the languages of the items.
UNITS = frozenset("""
litre litres liter grams gram gramm gramme grammes mile miles meile meilen lieue lieues hour hours stunde stunden heure heures day days tag tage tagen
jour jours week weeks woche wochen semaine semaines pound pounds pfund kilogram kilograms kilogramm kilo kilos metre metres meter mètre mètres
foot feet fuß pied pieds inch inches zoll pouce pouces yard yards ounce ounces unze unzen once onces minute minutes minuten percent prozent
""".split())

_WORD = re.compile(r"[\w|$]+(?:['’]\w+)?")
_NO_DIGIT = re.compile(r"\D+")
_CONFUSED = str.maketrans({**dict.fromkeys("ceoa0", "o"), **dict.fromkeys("hb6k", "h"), **dict.fromkeys("nuvmw", "n"), **dict.fromkeys("tflijr1!|:", "l"),
                           **dict.fromkeys("sz58", "s"), **dict.fromkeys("gqy9", "g"), **dict.fromkeys("dp", "d")})


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


class Canon:
    """Template and slot codes of folded words, given the vocabulary."""

    def __init__(self, vocabulary: Iterable[str]):
        self.vocabulary = frozenset(vocabulary)
        self.index: dict[str, int] = {}
        self.words: list[str] = []
        self.template = np.zeros(1024, dtype=np.uint64)
        self.slot = np.zeros(1024, dtype=np.uint64)
        # 0 a template word, 1 a name, 2 a number, 3 a word that is a unit behind a number
        self.kind = np.zeros(1024, dtype=np.int8)

    def codes(self, raw: list[str]) -> np.ndarray:
        """Index of each raw word, folded and coded on first sight."""
        index = self.index
        out = [index.get(w, -1) for w in raw]
        if -1 in out:
            for i, x in enumerate(out):
                if x < 0:
                    out[i] = index[raw[i]] if raw[i] in index else self._add(raw[i])
        return np.array(out, dtype=np.int64)

    def _add(self, raw: str) -> int:
        n = len(self.words)
        if n == len(self.kind):
            self.template, self.slot, self.kind = (np.concatenate([a, np.zeros_like(a)]) for a in (self.template, self.slot, self.kind))
        w = fold(raw)
        self.kind[n] = 2 if w.isdigit() else 3 if w in UNITS else 0 if w in self.vocabulary else 1
        sign = {1: "@", 2: "#"}.get(int(self.kind[n]))
        self.template[n] = _hash(sign or w)
        self.slot[n] = _hash(w) if sign else 0
        self.words.append(w)
        self.index[raw] = n
        return n

    def trim(self) -> None:
        """Forget the words seen, between batches, when there are very many."""
        if len(self.words) > 2_000_000:
            self.__init__(self.vocabulary)

    def windows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template key, slot key, whether it has slots) of the three words from each position on."""
        kind = self.kind[codes]
        unit = (kind == 3) & np.concatenate([[False], kind[:-1] == 2])
        t = np.where(unit, np.uint64(_hash("%")), self.template[codes])
        s = np.where(unit, self.template[codes], self.slot[codes])
        has = unit | (kind == 1) | (kind == 2)
        if len(codes) < 3:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        mix = lambda x: (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:]
        return mix(t), mix(s), has[:-2] | has[1:-1] | has[2:]


def slots_of(raw: list[str]) -> list[bool]:
    """Which words of an item are values: numbers, and names or other words with a
    capital inside a sentence.  It rests on the item alone, so it is the same
    whatever other items there are.  Raw words here end with their full stop."""
    out, first = [], True
    inner = {w.strip(".!?:;,()") for i, w in enumerate(raw) if i and w[:1].isupper() and raw[i - 1][-1:] not in ".!?:("}
    for i, w in enumerate(raw):
        bare = w.strip(".!?:;,()")
        after = raw[i + 1] if i + 1 < len(raw) else ""
        name = bare[:1].isupper() and (not first or bare in inner or (after[:1].isupper() and w[-1:] not in ".!?:"))
        out.append(name or fold(bare).isdigit())
        first = w[-1:] in ".!?:("
    return out


def _item_words(text: str) -> tuple[list[str], list[bool]]:
    """Raw words of an item and which of them are values."""
    raw, ends = [], []
    spans = list(_WORD.finditer(text))
    for a, b in zip(spans, [*spans[1:], None]):
        raw.append(a[0])
        between = text[a.end() : b.start() if b else len(text)]
        ends.append(a[0] + (between.strip()[:1] if between.strip()[:1] in (*".!?:(",) else ""))
    return raw, slots_of(ends)


def _chosen(canon: Canon, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, template key, slot key) of an item's windows that enter the join."""
    t, s, has = canon.windows(codes)
    keep = has.copy()
    # a stretch without slots that is long enough to be a passage of its own
    edges = np.flatnonzero(np.diff(np.concatenate([[True], has, [True]]).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a + 2 >= MIN_WORDS:
            keep[a:b] = True
    at = np.flatnonzero(keep)
    return at, t[at], s[at]


def _reaches(a: str, b: str, least: float) -> bool:
    """Whether the letters in common, whatever their order, allow this likeness."""
    need = least * (len(a) + len(b)) / 2
    return min(len(a), len(b)) >= need and sum(min(a.count(c), b.count(c)) for c in set(a)) >= need


@lru_cache(1 << 16)
def _like(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    # what is below this bound is below LIKE
    if not _reaches(a, b, LIKE):
        return 0.0
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


#: fixed values: letters that scanners read as two, or two as one
_MERGED = (("cl", "d"), ("tl", "d"), ("rn", "m"), ("ri", "n"), ("vv", "w"), ("ii", "u"), ("nn", "m"))


@lru_cache(1 << 16)
def _shape(word: str) -> str:
    """The word in letters that scanners confuse as one."""
    for a, b in _MERGED:
        word = word.replace(a, b)
    return word.translate(_CONFUSED)


@lru_cache(1 << 16)
def _same_slot(a: str, b: str) -> bool:
    """Whether b can be a misreading of the value a."""
    if a == b:
        return True
    p, q = _NO_DIGIT.sub("", a), _NO_DIGIT.sub("", b)
    # as many digits, but other ones: another value
    if p != q and len(p) == len(q) or a.isdigit() and b.isdigit():
        return False
    x, y = _shape(a), _shape(b)
    if x == y:
        return True
    return not a.isdigit() and min(len(x), len(y)) >= 5 and _reaches(x, y, 0.85) and SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.85


@lru_cache(1 << 16)
def _same_word(a: str, b: str) -> bool:
    if len(a) <= 3 and abs(len(a) - len(b)) <= 1 and a.translate(_CONFUSED) == b.translate(_CONFUSED):
        return True
    return _like(a, b) >= LIKE


#: item words and page words of a piece that a scanner cut or put together
_CUTS = ((1, 2), (2, 1), (2, 2), (1, 3), (3, 2), (2, 3))


def _walk(item: list[str], slots: list[bool], page: list[str], i: int, j: int, d: int) -> tuple[int, int, int, int]:
    """Follow the passage from (i, j) in direction d: (item position behind the
    last sure word, page position, slots held, slots met)."""
    n, m = len(item), len(page)
    held = met = 0
    sure = (i, j, 0, 0)
    while 0 <= i < n and 0 <= j < m:
        a, b = item[i], page[j]
        cut = a != b and _cut_exactly(item, page, i, j, d)
        if cut:
            di, dj = cut
            values = sum(slots[i + d * k] for k in range(di))
            held, met = held + values, met + values
            i, j = i + d * di, j + d * dj
            sure = (i, j, held, met)
            continue
        if a == b or (_same_slot if slots[i] else _same_word)(a, b):
            if slots[i]:
                met += 1
                held += a == b or _shape(a) == _shape(b)
            i, j = i + d, j + d
            # a short word that is only alike does not end a passage
            if a == b or len(a) > 2:
                sure = (i, j, held, met)
            continue
        for di, dj in _CUTS:
            lo, low = (i, j) if d > 0 else (i - di + 1, j - dj + 1)
            if lo < 0 or low < 0 or lo + di > n or low + dj > m:
                continue
            x, y = "".join(item[lo : lo + di]), "".join(page[low : low + dj])
            # a ratio of LIKE_CUT needs lengths within the same bound
            if 2 * min(len(x), len(y)) < LIKE_CUT * (len(x) + len(y)):
                continue
            value = any(slots[lo : lo + di])
            if x == y or (_same_slot(x, y) if value else len(x) > 3 and _like(x, y) >= LIKE_CUT):
                met += value
                held += value and (x == y or _shape(x) == _shape(y))
                i, j = i + d * di, j + d * dj
                sure = (i, j, held, met)
                break
        else:
            # a single letter read as another sign
            if len(a) == 1 and len(b) <= 2 and not a.isdigit() and 0 <= i + d < n and 0 <= j + d < m and item[i + d] == page[j + d]:
                i, j = i + d, j + d
                continue
            # a short word that the scanner lost
            if len(a) <= 2 and not slots[i] and 0 <= i + d < n and item[i + d] == b:
                i += d
                continue
            nxt = _behind_insert(item, page, i, j, d)
            if nxt is None:
                break
            j = nxt
    return sure


def _cut_exactly(item: list[str], page: list[str], i: int, j: int, d: int) -> tuple[int, int] | None:
    """(2, 1) or (1, 2) where two words here are one there, letter by letter."""
    a, b = item[i], page[j]
    if len(b) > len(a):
        k = i + d
        if 0 <= k < len(item) and len(item[k]) + len(a) == len(b) and b == (a + item[k] if d > 0 else item[k] + a):
            return 2, 1
    elif len(a) > len(b):
        k = j + d
        if 0 <= k < len(page) and len(page[k]) + len(b) == len(a) and a == (b + page[k] if d > 0 else page[k] + b):
            return 1, 2
    return None


def _behind_insert(item: list[str], page: list[str], i: int, j: int, d: int) -> int | None:
    """Where the passage goes on behind words that are not the item's."""
    n, m = len(item), len(page)
    ahead = item[i : i + 3] if d > 0 else item[max(0, i - 2) : i + 1][::-1]
    if len(ahead) < 2:
        return None
    if d > 0:
        near = page[j + 1 : j + 1 + MAX_INSERT]
    else:
        near = page[max(0, j - MAX_INSERT) : j][::-1]
    at = -1
    while ahead[0] in near[at + 1 :]:
        at = near.index(ahead[0], at + 1)
        k = j + d * (at + 1)
        if 0 <= k + d * (len(ahead) - 1) < m and all(page[k + d * t] == w for t, w in enumerate(ahead)):
            return k
    return None


def longest_run(
    item: list[str], slots: list[bool], page: list[str], anchors: list[tuple[int, int]] | None = None, enough: int | None = None
) -> int:
    """Most consecutive item words that the page repeats with consistent slots.

    ``anchors`` are positions (item, page) of windows that agree; without them
    all pairs of equal neighbouring words are.  A run of ``enough`` ends the search."""
    if anchors is None:
        at = defaultdict(list)
        for i in range(len(item) - 1):
            at[item[i], item[i + 1]].append(i)
        anchors = [(i, j) for j, w in enumerate(zip(page, page[1:])) for i in at.get(w, ())]
    best = 0
    done: list[tuple[int, int, int, int]] = []
    for i, j in sorted(anchors):
        if any(a <= i < b and c <= j < e for a, b, c, e in done):
            continue
        b, e, held, met = _walk(item, slots, page, i, j, 1)
        a, c, held_before, met_before = _walk(item, slots, page, i - 1, j - 1, -1)
        a, c = a + 1, c + 1
        done.append((a, b, c, e))
        if b - a > best and held + held_before >= SLOTS * (met + met_before):
            best = b - a
            if enough and best >= enough:
                break
    return best


def _enough(slots: list[bool], held: list[bool]) -> bool:
    """Whether some run of MIN_WORDS words or more has no slots or enough of them held."""
    # sums of held minus what is needed: a run of [a, b) has enough where it does not fall from a to b;
    # of a longer run with enough slots held, some part of these lengths has enough too
    at = list(accumulate((h - SLOTS * s for h, s in zip(held, slots)), initial=0.0))
    return any(max(at[a + MIN_WORDS : a + 2 * MIN_WORDS]) > x - 1e-6 for a, x in enumerate(at[:-MIN_WORDS]))


class Items:
    """The items of a small list, for one page at a time; ``find`` does the same by a join."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.words, self.slots, self.slot_words, self.ids = [], [], [], []
        raw = [(i, *_item_words(t)) for i, t in rows if t]
        raw = [(i, w, s) for i, w, s in raw if len(w) >= MIN_WORDS]
        self.canon = Canon(_vocabulary(w for _, w, _ in raw))
        self.table: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for k, (i, words, slots) in enumerate(raw):
            codes = self.canon.codes(words)
            folded = [self.canon.words[c] for c in codes]
            self.ids.append(i)
            self.words.append(folded)
            self.slots.append(slots)
            self.slot_words.append({w for w, s in zip(folded, slots) if s})
            for at, t, s in zip(*(x.tolist() for x in _chosen(self.canon, codes))):
                self.table[t, s].append((k, at))

    def possible(self, k: int, page: set[str]) -> bool:
        """Whether the slot values on the page allow item k a run that
        ``longest_run`` accepts; drops nothing that it would accept."""
        seen = self.slot_words[k] & page
        return _enough(self.slots[k], [s and w in seen for s, w in zip(self.slots[k], self.words[k])])

    def leaks(self, text: str, xs=None, ws=None) -> list[int]:
        """Items that the page leaks."""
        codes = self.canon.codes(_WORD.findall(joined(reading_order(text, xs, ws))))
        page = [self.canon.words[c] for c in codes]
        t, s, _ = self.canon.windows(codes)
        anchors = defaultdict(list)
        for j, w in enumerate(zip(t.tolist(), s.tolist())):
            for k, at in self.table.get(w, ()):
                anchors[k].append((at, j))
        return sorted(self.ids[k] for k, a in anchors.items() if longest_run(self.words[k], self.slots[k], page, a, MIN_WORDS) >= MIN_WORDS)


def _vocabulary(words: Iterable[list[str]]) -> list[str]:
    """Words that stand in small letters somewhere."""
    lower = Counter(w for ws in words for w in {fold(x) for x in ws if x[0].islower()})
    return [w for w, _ in sorted(lower.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if not w.isdigit()]


_ITEM = "item_id long, words array<string>, slots array<boolean>, lower array<string>"
_WINDOW = "item_id long, at int, key long, slot_key long"


def find(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every leak."""
    spark = documents.sparkSession
    workers_can_import(spark)
    scratch = Scratch(spark, "leakage")

    def read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, slots = _item_words(text)
                if len(words) >= MIN_WORDS:
                    rows.append((i, words, slots, sorted({fold(w) for w in words if w[0].islower()})))
            cols = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["item_id", "words", "slots", "lower"])

    asked = items.where(F.length(F.trim("text")) > 0).select(F.col("item_id").cast("long"), "text").distinct()
    known = scratch.put(asked.mapInArrow(read_items, _ITEM), "items")
    # at most VOCABULARY words come to the driver
    lower = known.select(F.explode("lower").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(VOCABULARY)
    vocabulary = [r["w"] for r in lower.collect() if not r["w"].isdigit()]

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(vocabulary)
        for b in batches:
            canon.trim()
            ids, ats, ts, ss = [], [], [], []
            for i, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, t, s = _chosen(canon, canon.codes(words))
                ids.append(np.full(len(at), i, dtype=np.int64))
                ats.append(at)
                ts.append(t)
                ss.append(s)
            whole = lambda x, k: np.concatenate(x).astype(k) if x else np.zeros(0, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(whole(ids, np.int64)), pa.array(whole(ats, np.int32)), pa.array(whole(ts, np.uint64).view(np.int64)),
                 pa.array(whole(ss, np.uint64).view(np.int64))], names=["item_id", "at", "key", "slot_key"])

    windows = scratch.put(known.select("item_id", "words").mapInArrow(item_windows, _WINDOW), "windows")
    bits = _filter_bits(windows)
    pages = scratch.put(_pages(documents, vocabulary, bits), "pages")
    hits = pages.select("doc_id", F.explode("hits").alias("x")).select("doc_id", "x.page_at", "x.key", "x.slot_key")
    # the template windows meet, and their slots agree; a window that many items or pages share is split by AQE
    pairs = hits.join(windows, ["key", "slot_key"]).groupBy("doc_id", "item_id").agg(
        F.collect_list(F.shiftleft(F.col("at").cast("long"), 32) + F.col("page_at")).alias("anchors"))
    flags = F.array_join(F.transform("slots", lambda x: F.when(x, "1").otherwise("0")), "")
    ready = (
        pairs.join(known.select("item_id", F.array_join("words", " ").alias("item"), flags.alias("slots")), "item_id")
        .join(pages.select("doc_id", "words"), "doc_id").select("doc_id", "item_id", "words", "item", "slots", "anchors")
    )
    return ready.mapInArrow(_verify, "doc_id long, item_id long").distinct()


def _filter_bits(windows: DataFrame) -> np.ndarray:
    """A bit for every window of an item; FILTER_BITS / 8 bytes at most, whatever the number of items."""
    bit = F.pmod(F.col("key").bitwiseXOR(F.col("slot_key")), F.lit(FILTER_BITS))
    maps = windows.groupBy(F.shiftright(bit, 15).alias("b")).agg(
        F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767)).cast("int")).alias("m"))
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in maps.collect():
        out[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(r["m"], dtype=np.uint8)
    return out


_PAGE = "doc_id long, words string, hits array<struct<page_at:int,key:long,slot_key:long>>"


def _pages(documents: DataFrame, vocabulary: list[str], bits: np.ndarray) -> DataFrame:
    """Pages with a window that an item may have: folded words and these windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(vocabulary)
        for b in batches:
            canon.trim()
            docs, texts, counts, ats, ts, ss = [], [], [0], [], [], []
            raw, sizes, ids = [], [], []
            for d, text, box in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), boxes(b.column(2))):
                words = _WORD.findall(joined(reading_order(text, *(box or (None, None)))))
                # fewer printed words can be a passage of MIN_WORDS only if words ran together
                if len(words) > 2:
                    raw += words
                    sizes.append(len(words))
                    ids.append(d)
            codes = canon.codes(raw)
            t, s, _ = canon.windows(codes)
            place = (t ^ s).view(np.int64) & (FILTER_BITS - 1)
            hit = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            ends = np.cumsum(sizes)
            owner = np.searchsorted(ends, hit, side="right")
            # windows across two pages are none
            inside = hit + 2 < ends[owner] if len(hit) else np.zeros(0, bool)
            hit, owner = hit[inside], owner[inside]
            for p in np.unique(owner).tolist():
                mine = hit[owner == p] if len(hit) < 2000 else hit[np.searchsorted(owner, p) : np.searchsorted(owner, p, side="right")]
                start = int(ends[p] - sizes[p])
                docs.append(ids[p])
                texts.append(" ".join([canon.words[c] for c in codes[start : start + sizes[p]].tolist()]))
                counts.append(counts[-1] + len(mine))
                ats.append(mine - start)
                ts.append(t[mine])
                ss.append(s[mine])
            whole = lambda x, k: np.concatenate(x).astype(k) if x else np.zeros(0, k)
            fields = [whole(ats, np.int32), whole(ts, np.uint64).view(np.int64), whole(ss, np.uint64).view(np.int64)]
            inner = pa.StructArray.from_arrays([pa.array(x) for x in fields], names=["page_at", "key", "slot_key"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), inner)],
                names=["doc_id", "words", "hits"])

    kept = documents.where(F.length(F.trim("text")) > 0).select(
        F.col("doc_id").cast("long"), "text",
        F.transform("line_boxes", lambda x: F.struct(x["x"].alias("x"), x["w"].alias("w"))).alias("line_boxes"),
    )
    return kept.mapInArrow(run, _PAGE)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[int | None, list[str]] = (None, [])
    low = (1 << 32) - 1
    for b in batches:
        docs, found = [], []
        items: dict[int, tuple[list[str], list[bool]]] = {}
        flat, ends = b.column(5).values.to_pylist(), b.column(5).offsets.to_pylist()
        for k, (d, i, words, item, slots) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)))):
            if last[0] != d:
                last = (d, words.split(" "))
            if i not in items:
                items[i] = ([fold(w) for w in item.split(" ")], [x == "1" for x in slots])
            anchors = [(x >> 32, x & low) for x in flat[ends[k] : ends[k + 1]]]
            if longest_run(*items[i], last[1], anchors, MIN_WORDS) >= MIN_WORDS:
                docs.append(d)
                found.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id"])
