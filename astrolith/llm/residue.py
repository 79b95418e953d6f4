"""Template residue and viewer messages in place of page content.

Pages are cut into segments by structure alone: marks of template languages,
and the sentences of the text in reading order.  No list of wordings decides
what becomes a segment.  Every distinct segment is a node with a 64-bit SimHash
of its letter groups, written in letters that scanners confuse as one.

Labels come from a small trusted seed:

* marks with delimiters that newspapers never print,
* filler: running text in small letters without any of the short words that
  every sentence needs (it has no copies, so its label does not travel),
* the few published notices in ``SEEDS``,
* segments of pages that hold nothing but segments which pages of ``COMMON`` or
  more different sources repeat, for reported news never repeats in every
  sentence.  Such pages must come from ``SOURCES`` sources and make up ``SHARE``
  of all pages of the segment, so that a sentence of the news that chance
  repeats is not trusted, however large the corpus.

From there labels travel.  The bits are cut into blocks, every pair of blocks
keys one table, segments that share a key are compared by Hamming distance and
then by text likeness, and every node linked to a labelled one takes its label,
in rounds, through the connected components.  A family that outgrows its
trusted node (under ``SHARE`` of the family's pages) is no damaged copy of a
message but a common sentence, and loses its labels.  A page with a labelled
node is residue.

Exact copies are one node, so a message on a third of all pages costs one
node.  Buckets are split by leader: each labelled node remembers the trusted
node its label came from (its leader) and its distance to it, and an open node
is compared with the members of a leader's family only if it is near enough to
the leader for a link to be possible (triangle inequality, so nothing is lost).

Defined results: NULL, empty and blank texts are no residue; repeated pages
each count; pages and segments of any length are read whole; a NULL source is
one source of its own; without the column all pages are of one source.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.llm.pages import boxes, fold, joined, reading_order
from astrolith.runtime import Scratch, workers_can_import

#: every pair up to BLOCKS - 2 bits apart shares a table; farther ones up to HAMMING may
BLOCKS, HAMMING, LIKE = 8, 12, 0.8
#: bits by which the finer SimHash (groups of four) of texts that alike may differ
FINE = 18
#: sources that must repeat every segment of a page (sources count by 64 classes, so that two may count as one); sources and share of pages of that sort that a segment needs
COMMON, SOURCES, SHARE = 3, 2, 0.2
MIN_LETTERS = 8
#: share of the longest line below which a line ends early, on pages of more lines than these
PARAGRAPH, FEW_LINES = 0.8, 10

# Reason phrases of HTTP, notices that servers and browsers ship with, customary filler.
SEEDS = """
400 Bad Request
401 Unauthorized
403 Forbidden
404 Not Found
408 Request Timeout
500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
The requested URL was not found on this server.
Please enable JavaScript to view this page.
Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.
Veuillez activer JavaScript pour afficher cette page.
Active JavaScript para ver esta página.
Your session has expired.
You do not have permission to view this page.
Insert your text here.
Sample text sample text.
Text text.
Blindtext Blindtext.
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
"""
#: marks of template languages: double delimiters, and single ones around names
MARK = regex.compile(r"""
 \{\{\s*[\w.\s]{2,40}?\s*\}\}? | \$\{\s*[\w.\s·]{2,40}\}? | \{%\s*[\w.\s]{2,40}%?\} | <%=?\s*[\w.\s]{2,40}%?> | \[\[\s*[\w.\s]{2,40}\]\]? | <<\s*[\w.\s]{2,40}>>?
 | %%\s*[\w.\s]{2,40}?%% | @@\s*[\w.\s]{2,40}?@@ | __[A-Za-z0-9]\w{1,38}__ | \#\{\s*[\w.\s]{2,40}\} | %\(\s*\w{2,30}\s*\)[a-z]? | \$[A-Z]{2,}_[A-Z]{2,}\b
 | \{\s?\w{1,3}\s?\} | <[\p{L}\d_]{3,20}> | \[[\p{L}\d]{3,20}(?:\s[\p{L}\d]{2,20}){0,3}\] | «\p{L}{3,}(?:\s\p{L}+){0,3}» | \bTK(?:\s+TK)+\b
 """, regex.X)
#: words inside single brackets that announce a value to be filled in
SLOT_WORDS = frozenset("name names nombre nom vorname nachname fecha date datum author autor auteur byline title titel titre titulo caption text texte texto "
                       "article artikel city town stadt ville ciudad headline einsetzen insert insérer insertar reporter price preis body photo".split())
#: filler runs on at least this many words without one of up to SHORT letters; languages
#: written without blanks or with long words only (not Latin script) are left out
FILLER_WORDS, SHORT, LETTERS = 12, 3, 4.5
#: pages of at most this many segments also give their neighbouring segments in pairs, for sentences
#: whose full stop a scanner has lost (elsewhere such a sentence is a segment, and links to the pair)
PAIRED = 6
TEXT, MARKED, PAIR, FILLER = range(4)

_SENTENCE = re.compile(r"([.!?:·])\s+")
_BAR = re.compile(r"\s\|\s")
_BEGIN = re.compile(r"[A-Z0-9<©]")
_NOT_WORD = re.compile(r"(?:[^\w\x1e]|_)+")
_NUMBER = re.compile(r"\d+")
_OTHER_SIGN = re.compile(r"[^\w\x00-\x7f]+")
#: ASCII signs as blanks, but for the mark between segments
_BLANKS = {i: " " for i in range(128) if not chr(i).isalnum() and chr(i) != "\x1e"}
_CONFUSED = str.maketrans({**dict.fromkeys("ceoa0", "o"), **dict.fromkeys("hb6k", "h"), **dict.fromkeys("nuvmw", "n"), **dict.fromkeys("tflijr1!|:", "l"),
                           **dict.fromkeys("sz58", "s"), **dict.fromkeys("gqy9", "g"), **dict.fromkeys("dp", "d")})


_MARKS = re.compile("[\u0300-\u036f]+")


def _squeeze(text: str) -> str:
    """Lower case, Latin letters without accents, numbers alike, signs as blanks."""
    low = text.lower()
    if not low.isascii():
        for a, b in (("ß", "ss"), ("ſ", "s"), ("æ", "ae"), ("œ", "oe")):
            low = low.replace(a, b)
        low = _OTHER_SIGN.sub(" ", _MARKS.sub("", unicodedata.normalize("NFKD", low)))
    if low.isascii():
        low = low.translate(_BLANKS)
    else:
        low = _NOT_WORD.sub(" ", low)
    return _NUMBER.sub(_number, low)


def _number(m: re.Match) -> str:
    """``#`` for a number of its own, not for digits inside a word."""
    a, b = m.span()
    s = m.string
    return m[0] if a and s[a - 1].isalnum() or b < len(s) and s[b].isalnum() else "#"


def skeleton(node: str) -> str:
    """The node in letters that scanners confuse as one."""
    return node.translate(_CONFUSED)


def _bits(group: str, size: int) -> np.ndarray:
    """64 counters of one byte: 1 where the group's hash has a 1."""
    raw = np.frombuffer(blake2b(f"{size}:{group}".encode(), digest_size=8).digest(), dtype=np.uint8)
    return np.unpackbits(raw).view(np.uint64)


_CLASS = np.array([{" ": 0, "#": 1, "o": 2, "h": 3, "n": 4, "l": 5, "s": 6, "g": 7, "d": 8, "x": 9}.get(chr(i), 10 + i % 6) for i in range(256)], dtype=np.int64)
_PAIRS, _TRIPLES, _FOURS = (
    np.stack([*(_bits(str(i), size) for i in range(n)), np.zeros(8, dtype=np.uint64)]) for size, n in ((2, 256), (3, 4096), (4, 4096)))
#: a triple with the pair it begins with, for both at once
_BOTH = _TRIPLES.copy()
_BOTH[:4096] += np.repeat(_PAIRS[:256], 16, axis=0)
#: skeletons hashed at once: the counters of a stretch stay in the cache
_CHUNK = 2_000


def simhashes(skeletons: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit SimHashes of each skeleton: of its letter pairs and triples, and of its groups of four.

    Byte-wide counters, eight in a word, are summed in stretches that cannot
    overflow them, and the stretches in whole numbers.
    """
    got = [_simhashes(skeletons[i : i + _CHUNK]) for i in range(0, len(skeletons), _CHUNK)]
    if not got:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])


def _simhashes(skeletons: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(" ".join(["", *skeletons, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    c = np.where(flat < 256, _CLASS[np.minimum(flat, 255)], 10 + flat % 6)
    sizes = np.array([len(s) for s in skeletons], dtype=np.int64)
    # a skeleton with its blank on either side has size + 1 pairs, size triples, size - 1 fours
    first = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    pairs = c[:-1] * 16 + c[1:]
    coarse, fine = np.zeros((len(sizes), 64), dtype=np.int32), np.zeros((len(sizes), 64), dtype=np.int32)
    # the pair that no triple begins with is each skeleton's last
    coarse += _PAIRS[pairs[first + sizes]].view(np.uint8).reshape(len(sizes), 64)
    tables = ((_BOTH, pairs[:-1] * 16 + c[2:], sizes, coarse, 127),
              (_FOURS, (pairs[:-2] * 251 + pairs[2:] * 17) & 4095, np.maximum(sizes - 1, 1), fine, 255))
    for table, codes, n, total, most in tables:
        parts = -(-n // most)
        owner = np.repeat(np.arange(len(n)), parts)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        # each stretch is followed by what stands between it and the next
        begin = first[owner] + most * step
        end = np.minimum(begin + most, (first + n)[owner])
        # the last row of each table counts nothing
        words = table[np.concatenate([codes, [len(table) - 1] * 2])]
        counts = np.add.reduceat(words, np.stack([begin, end], axis=1).ravel(), axis=0)[::2].view(np.uint8).reshape(len(owner), 64)
        if len(owner) > len(n):
            total += np.add.reduceat(counts.astype(np.int32), np.cumsum(parts) - parts, axis=0)
        else:
            total += counts
    pack = lambda total, n: np.packbits(total * 2 > n[:, None], axis=1, bitorder="little").view(np.int64).ravel()
    return pack(coarse, 2 * sizes + 1), pack(fine, np.maximum(sizes - 1, 1))


def simhash(node: str) -> int:
    """Signed 64-bit SimHash of one node."""
    return int(simhashes([skeleton(" ".join(_squeeze(node).split()))])[0][0])


def _trusted_mark(mark: str) -> bool:
    if mark[0] == "[" and mark[1] != "[":
        inner = mark[1:-1]
        return not any(c.isdigit() for c in inner) and (inner.isupper() or any(fold(w) in SLOT_WORDS for w in inner.split()))
    if mark[0] == "«":
        return mark.isupper()
    return True


def _filler(raw: str, node: str) -> bool:
    """A long run of words without short ones or names."""
    if len(node) < FILLER_WORDS * LETTERS or "#" in node:
        return False
    words = node.split()
    if len(words) < FILLER_WORDS or not node.isascii() or len(node) < (LETTERS + 1) * len(words):
        return False
    capital = sum(w[0].isupper() for w in raw.split())
    return len(set(words)) > 2 and sum(len(w) <= SHORT for w in words) * 20 <= len(words) and capital * 10 <= len(words)


def _once(node: str) -> str:
    """One or two words said over and over become twice the same, however often they stand."""
    first = node.partition(" ")[0]
    if node.count(first) < 3:
        return node
    words = node.split()
    for size in (1, 2):
        if len(words) > 2 * size and all(w == words[i % size] for i, w in enumerate(words)):
            return " ".join(words[:size] * 2)
    return node


def segments(text: str, xs=None, ws=None) -> list[tuple[str, bool, int]]:
    """(node, trusted, kind) of every segment of a page."""
    lines = reading_order(text, xs, ws)
    # a line that ends early ends a paragraph, if the next one begins like one; on a page of few lines any does
    full = PARAGRAPH * max(map(len, lines)) if len(lines) > FEW_LINES else len(text) + 1
    for i in range(len(lines) - 1):
        if len(lines[i]) < full and _BEGIN.match(lines[i + 1]):
            lines[i] += "\x1e"
    flat = joined(lines)
    out = []
    if any(c in text for c in "{[<%@_$«") or "TK" in text:
        out = [(" ".join(fold(w) for w in m[0].split()), _trusted_mark(m[0]), MARKED) for m in MARK.finditer(flat)]
    cut = _SENTENCE.sub("\\1\x1e", flat)
    if "|" in cut:
        cut = _BAR.sub("\x1e", cut)
    run = []
    for raw, node in zip(cut.split("\x1e"), _squeeze(cut).split("\x1e")):
        node = " ".join(node.split())
        if len(node) - node.count(" ") - node.count("#") >= MIN_LETTERS:
            sure = _filler(raw, node)
            run.append((_once(node), sure, FILLER if sure else TEXT))
    out += run
    if 1 < len(run) <= PAIRED:
        out += [(f"{a[0]} {b[0]}", False, PAIR) for a, b in itertools.pairwise(run)]
    return list(dict.fromkeys(out))


def candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, source, node, sim, fine, trusted, kind) of every segment; one Arrow pass."""
    workers_can_import(documents.sparkSession)
    names = ["doc_id", "source", "node", "sim", "fine", "trusted", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, (text, box) in enumerate(zip(b.column(2).to_pylist(), boxes(b.column(3)))):
                got = segments(text, *(box or (None, None)))
                at += [i] * len(got)
                found += got
            nodes, trusted, kinds = zip(*found) if found else ((), (), ())
            pick = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pick), b.column(1).take(pick), pa.array(nodes, pa.string()), *map(pa.array, simhashes([skeleton(n) for n in nodes])),
                 pa.array(trusted, pa.bool_()), pa.array(kinds, pa.int32())], names=names)

    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in documents.columns else F.lit("")
    pages = documents.where(F.length(F.trim("text")) > 0).select(
        F.col("doc_id").cast("long"), F.pmod(F.xxhash64(source), F.lit(64)).alias("source"), "text",
        F.transform("line_boxes", lambda x: F.struct(x["x"].alias("x"), x["w"].alias("w"))).alias("line_boxes"),
    )
    return pages.mapInArrow(run, "doc_id long, source long, node string, sim long, fine long, trusted boolean, kind int")


def _skeleton_column(node: str = "node"):
    a, b = zip(*((chr(k), v) for k, v in _CONFUSED.items()))
    return F.translate(F.col(node), "".join(a), "".join(b))


def _key():
    """A node's id: its skeleton's hash beside its SimHash, 128 bits."""
    return F.xxhash64("skeleton").alias("h")


_WIDTH = 64 // BLOCKS
_TABLES = list(itertools.combinations(range(BLOCKS), 2))


def _table_keys(sim: str):
    """One key per pair of blocks: C(8, 2) = 28 tables of 16 bits."""
    block = [F.shiftrightunsigned(F.col(sim), i * _WIDTH).bitwiseAND(F.lit((1 << _WIDTH) - 1)) for i in range(BLOCKS)]
    return F.array(*[
        F.struct(F.lit(t).alias("t"), (F.shiftleft(block[a], _WIDTH) + block[b]).cast("int").alias("k")) for t, (a, b) in enumerate(_TABLES)
    ])


#: lengths in bands, each a quarter longer than the one before
_BANDS, _STEP = 24, 1.25


def _band(n):
    return np.minimum(np.log(np.maximum(n, 1)) / np.log(_STEP), _BANDS - 1).astype(np.int64)


_PACKED = (("h", np.int64), ("sim", np.int64), ("fine", np.int64), ("n", np.int32), ("n_pages", np.int64))


def _packed(nodes: DataFrame) -> DataFrame:
    """The nodes' numbers as byte strings of one Arrow batch each, so that the rounds
    look all of them up without a row of the engine for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary()) for c, (_, kind) in zip(b.columns, _PACKED)],
                names=[n for n, _ in _PACKED])

    names = [n for n, _ in _PACKED]
    # NULL pages stand for none: only trusted nodes may have none, and they are no open nodes
    return nodes.select(*names[:-1], F.coalesce("n_pages", F.lit(0)).cast("long").alias("n_pages")).mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def _hits(packed: DataFrame, front_keys: DataFrame) -> DataFrame:
    """(h, sim, fine, n, n_pages, t, k): the keys of the packed nodes that a front node of fitting length has too.

    The front's keys become one bit map a table and band of lengths: 28 x 24 maps of 65,536 bits,
    5.5 MB whatever the data, which every task looks up for all tables at once.
    """
    maps = np.zeros((len(_TABLES), _BANDS, 1 << (2 * _WIDTH - 3)), dtype=np.uint8)
    fits = front_keys.groupBy("t", "k").agg(F.min("n2").alias("low"), F.max("n2").alias("high"))
    # texts alike by LIKE differ in length by at most this factor
    factor = (2 - LIKE) / LIKE
    band = lambda c: F.least(F.greatest(F.floor(F.ln(c) / np.log(_STEP)), F.lit(0)), F.lit(_BANDS - 1))
    spread_out = fits.select("t", F.explode(F.sequence(band(F.greatest(F.col("low") / factor, F.lit(1.0))), band(F.col("high") * factor))).alias("band"), "k")
    grouped = spread_out.groupBy("t", "band", F.shiftright("k", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("k").bitwiseAND(F.lit(32767))).alias("m"))
    for r in grouped.collect():
        maps[r["t"], r["band"], r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(r["m"], dtype=np.uint8)
    flat, bit = maps.reshape(len(_TABLES), -1), (1 << np.arange(8)).astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))):
            columns = [np.frombuffer(x, dtype=kind) for x, (_, kind) in zip(whole, _PACKED)]
            sim = columns[1].view(np.uint64)
            base = _band(columns[3]) * maps.shape[2]
            block = [(sim >> np.uint64(i * _WIDTH) & np.uint64((1 << _WIDTH) - 1)).astype(np.int32) for i in range(BLOCKS)]
            rows, ts, ks = [], [], []
            for t, (x, y) in enumerate(_TABLES):
                k = (block[x] << _WIDTH) + block[y]
                hit = np.flatnonzero(np.take(flat[t], base + (k >> 3)) & bit[k & 7])
                rows.append(hit)
                ts.append(np.full(len(hit), t, dtype=np.int32))
                ks.append(k[hit])
            pick = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c[pick]) for c in columns], pa.array(np.concatenate(ts)), pa.array(np.concatenate(ks))], names=[*(n for n, _ in _PACKED), "t", "k"])

    return packed.mapInArrow(run, "h long, sim long, fine long, n int, n_pages long, t int, k int")


def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        m = SequenceMatcher(None, x, y, autojunk=False)
        out.append(m.real_quick_ratio() >= LIKE and m.quick_ratio() >= LIKE and m.ratio() >= LIKE)
    return pa.array(out, pa.bool_())


def _apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (h, sim, h2, sim2, ...) whose texts are alike."""
    text = lambda h, s, n: texts.select(F.col("h").alias(h), F.col("sim").alias(s), F.col("node").alias(n))
    both = pairs.join(text("h", "sim", "n1"), ["h", "sim"]).join(text("h2", "sim2", "n2"), ["h2", "sim2"])
    # no texts this likely are farther apart, and this test needs no Python
    near = F.levenshtein("n1", "n2") <= (1 - LIKE) * (F.length("n1") + F.length("n2"))
    return both.where(near & F.arrow_udf(_alike, "boolean")("n1", "n2")).drop("n1", "n2")


def spread(rows: DataFrame, nodes: DataFrame, trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, sim) of all nodes that a trusted label reaches.

    ``nodes`` has h, sim, fine, n (length) and n_pages, each node once; ``rows`` has h, sim and
    node (text) of every segment; ``trusted`` has h and sim of some nodes.  NULL n_pages exempts
    a trusted node from the test on its family's size.

    Labels travel in rounds from the nodes labelled last to those without a
    label.  Links between unlabelled nodes carry nothing and are never made.
    Texts are fetched for the nodes of near pairs only.
    """
    put, drop = scratch.put, scratch.drop
    start = nodes.join(trusted, ["h", "sim"], "left_semi")
    known = put(start.select("h", "sim", "fine", "n", F.col("sim").alias("lead"), "n_pages", F.lit(0).alias("turn"), F.lit(False).alias("off")), "known")
    packed = put(_packed(nodes), "packed")
    turn = 0
    while True:
        front = known.where((F.col("turn") == turn) & ~F.col("off"))
        if not front.limit(1).count():
            return known.where(~F.col("off")).select("h", "sim")
        keys = put(
            front.select(F.col("h").alias("h2"), F.col("sim").alias("sim2"), F.col("fine").alias("fine2"), F.col("n").alias("n2"), "lead",
                         _apart("sim", "lead").alias("r"), F.explode(_table_keys("sim")).alias("x"))
            .select("h2", "sim2", "fine2", "n2", "lead", "r", "x.t", "x.k"), "keys")
        # what is known already is left out behind the filter, where few rows are left
        hits = _hits(packed, keys).join(known.select("h", "sim"), ["h", "sim"], "left_anti")
        families = keys.groupBy("t", "k", "lead").agg(F.max("r").alias("r"))
        near = hits.join(families, ["t", "k"]).where(_apart("sim", "lead") <= F.lit(HAMMING) + F.col("r")).drop("r")
        # texts of this likeness have lengths within the same bound
        fits = F.least("n", "n2") * 2 >= LIKE * (F.col("n") + F.col("n2"))
        close = (_apart("sim", "sim2") <= HAMMING) & (_apart("fine", "fine2") <= FINE)
        pairs = put(near.join(keys, ["t", "k", "lead"]).where(close & fits)
                    .select("h", "sim", "fine", "n", "n_pages", "h2", "sim2", "lead").distinct(), "pairs")
        wanted = pairs.select("h", "sim").unionByName(pairs.select(F.col("h2").alias("h"), F.col("sim2").alias("sim"))).distinct()
        texts = put(rows.join(wanted, ["h", "sim"], "left_semi").groupBy("h", "sim").agg(F.min("node").alias("node")), "texts")
        # the nearest label first: most nodes need no other comparison
        own_columns = ["h", "sim", "fine", "n", "n_pages"]
        best = pairs.groupBy(*own_columns).agg(F.min_by(F.struct("h2", "sim2", "lead"), F.struct(_apart("sim", "sim2"), "h2", "sim2")).alias("x")).select(
            *own_columns, "x.h2", "x.sim2", "x.lead")
        first = put(_linked(best, texts).select(*own_columns, "lead"), "first")
        others = _linked(pairs.join(first, ["h", "sim"], "left_anti"), texts)
        second = others.groupBy(*own_columns).agg(F.min_by("lead", F.struct(_apart("sim", "lead"), "lead")).alias("lead"))
        turn += 1
        news = first.unionByName(second).withColumn("turn", F.lit(turn)).withColumn("off", F.lit(False))
        grown = put(known.unionByName(news), "grown")
        own = F.sum(F.when(F.col("turn") == 0, F.col("n_pages")))
        # a family without pages of its own root is a seed's: nothing to compare it with
        outgrown = grown.groupBy("lead").agg(own.alias("own"), F.sum("n_pages").alias("all")).where(F.col("own") < SHARE * F.col("all"))
        # its nodes stay in the list, without their label, so that no other round takes them up
        outgrown = outgrown.select("lead", F.lit(True).alias("grew"))
        new_known = put(grown.join(outgrown, "lead", "left").select(
            "h", "sim", "fine", "n", "lead", "n_pages", "turn", (F.col("off") | F.coalesce("grew", F.lit(False))).alias("off")), "known")
        drop(keys, pairs, texts, first, grown, known)
        known = new_known


def labelled(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Skeletons of all classes that a trusted label reaches; ``rows`` has node, skeleton, sim, trusted."""
    rows = scratch.put(rows.withColumn("h", _key()), "rows")
    nodes = scratch.put(rows.groupBy("h", "sim").agg(
        F.max("trusted").alias("trusted"), F.min("skeleton").alias("skeleton"), F.lit(None).cast("long").alias("n_pages"),
        F.lit(0).cast("long").alias("fine"), F.min(F.length("node")).alias("n")), "nodes")
    return nodes.join(spread(rows, nodes, nodes.where("trusted").select("h", "sim"), scratch), ["h", "sim"], "left_semi").select("skeleton")


def _seeds(rows: DataFrame) -> DataFrame:
    """The seed notices as rows without a page."""
    texts = [s for s in (" ".join(_squeeze(x).split()) for x in SEEDS.split("\n")) if s]
    data = [(n, int(a), int(b)) for n, a, b in zip(texts, *simhashes([skeleton(n) for n in texts]))]
    spark = rows.sparkSession
    return spark.createDataFrame(data, "node string, sim long, fine long").select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("source"), "node", "sim", "fine", F.lit(True).alias("trusted"), F.lit(TEXT).alias("kind"))


def _labels(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows of all segments, (h, sim) of the labelled nodes)."""
    put = scratch.put
    rows = candidates(documents)
    rows = put(rows.unionByName(_seeds(rows)).withColumn("skeleton", _skeleton_column()).withColumn("h", _key()).drop("skeleton"), "segments")
    # numbers only, so that a message on most pages is one row a task; sources are counted by class, one bit each
    classes = F.bit_count(F.bit_or(F.expr("shiftleft(1L, cast(source as int))")))
    nodes = put(rows.groupBy("h", "sim").agg(
        F.max((F.col("trusted") & (F.col("kind") != FILLER)).cast("int")).alias("trusted"), F.min("fine").alias("fine"), F.min(F.length("node")).alias("n"),
        classes.alias("n_sources"), F.count("doc_id").alias("n_pages"), F.max((F.col("kind") != PAIR).cast("int")).alias("single")), "nodes")
    common = nodes.where(F.col("n_sources") >= COMMON).select("h", "sim", F.lit(1).alias("common"))
    texts = rows.where(F.col("kind").isin(TEXT, PAIR, FILLER) & F.col("doc_id").isNotNull()).select("h", "sim", "doc_id", "source", "kind")
    wholly = (
        texts.where(F.col("kind") != PAIR).join(common, ["h", "sim"], "left").groupBy("doc_id").agg(F.min(F.coalesce("common", F.lit(0))).alias("all_common"))
        .where(F.col("all_common") == 1).select("doc_id")
    )
    repeated = (
        texts.join(wholly, "doc_id", "left_semi").groupBy("h", "sim").agg(F.count(F.lit(1)).alias("n_wholly"), classes.alias("n_wholly_sources"))
        .where(F.col("n_wholly_sources") >= SOURCES)
    )
    repeated = nodes.join(repeated, ["h", "sim"]).where(F.col("n_wholly") >= SHARE * F.col("n_pages")).select("h", "sim")
    trusted = put(nodes.where(F.col("trusted") == 1).select("h", "sim").unionByName(repeated).distinct(), "trusted")
    # pairs of segments give labels, but take none; the seeds have no pages
    nodes = nodes.join(trusted.withColumn("t", F.lit(1)), ["h", "sim"], "left").where((F.col("single") == 1) | F.col("t").isNotNull())
    nodes = nodes.select("h", "sim", "fine", "n", F.when(F.col("n_pages") > 0, F.col("n_pages")).alias("n_pages"))
    return rows, spread(rows, nodes, trusted, scratch)


def find(documents: DataFrame) -> DataFrame:
    """doc_id of every page on which residue stands, wholly or in part."""
    rows, known = _labels(documents, Scratch(documents.sparkSession, "residue"))
    found = rows.where(F.col("doc_id").isNotNull())
    # rows trusted by themselves need no join, so a mark on most pages is not a hot key
    sure = found.where("trusted").select("doc_id")
    rest = found.where(~F.col("trusted")).join(known, ["h", "sim"], "left_semi").select("doc_id")
    return sure.unionByName(rest).distinct()


def classes(documents: DataFrame) -> DataFrame:
    """Residue nodes: least text, pages, and whether the segment was trusted by itself."""
    rows, known = _labels(documents, Scratch(documents.sparkSession, "residue"))
    pages = rows.where(F.col("doc_id").isNotNull())
    return (
        pages.where(F.col("kind") != FILLER).join(known, ["h", "sim"], "left_semi").unionByName(pages.where(F.col("kind") == FILLER))
        .groupBy("h", "sim", "doc_id").agg(F.min("node").alias("node"), F.max(F.col("trusted").cast("int")).alias("trusted"))
        .groupBy("h", "sim").agg(F.min("node").alias("text"), F.count("doc_id").alias("n_pages"), F.max("trusted").alias("by_pattern"))
        .withColumn("skeleton", _skeleton_column("text")).select("skeleton", "text", "n_pages", "by_pattern")
    )
