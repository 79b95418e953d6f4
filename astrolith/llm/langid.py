"""Natural language hidden inside code, found by compression.

A literal's raw spelling is undone (adjacent pieces joined, escapes decoded)
and cut into spans at markup, comment signs, format specifiers and line ends.
Every span of at least four words (or a CJK clause) is encoded with a
zstandard dictionary per language and one of code; the shortest encoding wins.
A margin test rejects spans that no language shortens well or that the code
dictionary shortens as well as the best language.

The dictionaries start from labelled sentences and are extended by
self-training in ``ROUNDS`` rounds on a bounded sample of the column (``SAMPLE``
texts of up to ``SAMPLE_LENGTH`` characters, the least hashes, so that the sample
does not depend on partitioning): spans that win clearly join the dictionary of
their language.  Everything is then classified.

Defined results: NULL, empty and blank texts give nothing; one language per
text, that of the span it shortens most; texts of any length are read whole.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.llm.labelled_text import CODE, TEXT
from astrolith.runtime import workers_can_import

#: documented bounds of the fitted part
SAMPLE = 20_000
#: longer texts are left out of the sample (never out of the result)
SAMPLE_LENGTH = 4_000
DICTIONARY_BYTES = 48_000
ROUNDS = 2
LEVEL = 12
MIN_WORDS = 4
#: signs of a Chinese or Japanese clause; from SURE_CJK on a tie with code is accepted
MIN_CJK = 4
SURE_CJK = 8
#: margin test: a span must shrink at least to this share of its length, and
#: beat code by this share of its length
MAX_RATIO = 0.97
CODE_MARGIN = 0.03

_JOIN = regex.compile(r'(?<!\\)"(?:\s|\\[ntrv])*"')
_ESCAPE = regex.compile(r"((?:\\x[0-9A-Fa-f]{2}|\\[0-7]{3})+)|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\([\"'\\?ntrabfv0])")
_BYTE = regex.compile(r"\\x([0-9A-Fa-f]{2})|\\([0-7]{3})")
_ANSI = regex.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_CUT = regex.compile(
    r"<[^<>]*>|//|/\*|\*/|--+|[\n\r\t\x00-\x1f{};=<>|#\"\u00a0]+|\bTODO:|%\d+\$\w|\[%\w+\]|\[0x%\w+\]|[。！？]|\s\*\s|^\s*\*\s"
)
#: a statement of SQL: upper-case keywords around names in lower case
_SQL = regex.compile(r"\b(?:SELECT|INSERT INTO|DELETE FROM|UPDATE|CREATE TABLE)\b(?=[^\n]*[a-z])[^\n]*?\b(?:FROM|VALUES|SET|WHERE)\b.*?(?=--|;|\n|\"|$)")
_FORMAT = regex.compile(r"%[-+ 0#]*\d*(?:\.\d+)?(?:l|ll|h|z)?[a-zA-Z]\b|\{\d*\}|&\w+;")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "a": "\n", "b": "\n", "f": "\n", "v": "\n", "0": "\n"}


def unspell(raw: str) -> str:
    """The text that a raw literal spelling stands for."""
    if '"' in raw:
        raw = _JOIN.sub("", raw)
    if "\\" not in raw:
        return raw

    def one(m: regex.Match) -> str:
        if m[1]:
            data = bytes(int(a, 16) if a else int(b, 8) & 255 for a, b in _BYTE.findall(m[1]))
            return data.decode("utf-8", "replace")
        if m[2] or m[3]:
            n = int(m[2] or m[3], 16)
            return chr(n) if n < 0x110000 else "\ufffd"
        return _SIMPLE.get(m[4], m[4])

    return _ESCAPE.sub(one, raw)


def spans(raw: str | None) -> list[str]:
    """Candidate spans: at least four words, or a CJK clause."""
    if not raw or not raw.strip():
        return []
    text = _SQL.sub("\n", _ANSI.sub("\n", unspell(raw)))
    out = []
    for part in _CUT.split(text):
        if len(part) < MIN_CJK:
            continue
        s = _FORMAT.sub(" ", part).strip(" .,:!?()[]*'`-")
        words = [w for w in s.split() if _WORD.search(w)]
        if len(_CJK.findall(s)) >= MIN_CJK or len(words) >= MIN_WORDS:
            out.append(s)
    return out


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").replace("ł", "l")


def _umlaut(s: str) -> str:
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = s.replace(a, b)
    return s


class Identifier:
    """Dictionaries per language and the decision rule."""

    def __init__(self, more: dict[str, list[str]] | None = None):
        self.names, self.coders = [], []
        for lang, text in [*TEXT.items(), ("code", CODE)]:
            lines = [x for x in text.lower().split("\n") if x]
            if lang not in ("zh", "ja", "ru", "code"):
                lines = [_umlaut(x) for x in lines if lang == "de"] + [_fold(x) for x in lines if lang != "en"] + lines
            added = (more or {}).get(lang, [])
            if lang not in ("zh", "ja", "ru", "en", "code"):
                added = [y for x in added for y in dict.fromkeys((x, _fold(x), _umlaut(x) if lang == "de" else x))]
            # the nearest text is the cheapest to refer to: seeds last
            data = ("\n".join([*added, *lines]) + "\n").encode()[-DICTIONARY_BYTES:]
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.names.append(lang)
            self.coders.append(zstandard.ZstdCompressor(
                dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def costs(self, span: str) -> dict[str, int]:
        data = span.lower().encode()
        kana, han, cyrillic = (bool(regex.search(p, span)) for p in (r"[\p{Hiragana}\p{Katakana}]", r"\p{Han}", r"\p{Cyrillic}"))
        # a script that a language does not use cannot be it
        can = {"ja"} if kana else {"zh", "ja"} if han else {"ru"} if cyrillic else None
        return {
            n: len(c(data)) - 9  # frame overhead
            for n, c in zip(self.names, self.coders)
            if n == "code" or (n in can if can else n not in ("zh", "ja", "ru"))
        }

    def decide(self, span: str) -> tuple[str, float, float] | None:
        """(language, ratio, margin over code) of a span that passes the test."""
        size = len(span.encode())
        costs = self.costs(span)
        code = costs.pop("code")
        lang = min(costs, key=costs.get)
        ratio, margin = costs[lang] / size, (code - costs[lang]) / size
        if ratio <= MAX_RATIO and margin >= CODE_MARGIN:
            return lang, ratio, margin
        # code has no clauses in these scripts: here a tie with code is enough
        if lang in ("zh", "ja", "ru") and margin >= 0 and (lang == "ru" or len(_CJK.findall(span)) >= SURE_CJK):
            return lang, ratio, margin
        return None

    def text(self, raw: str | None) -> tuple[str, int] | None:
        """(language, characters of natural language) of one literal."""
        best: Counter = Counter()
        chars = 0
        for s in spans(raw):
            if d := self.decide(s):
                best[d[0]] += len(s) * (1 - d[1])
                chars += len(s)
        return (best.most_common(1)[0][0], chars) if best else None


def fit(df: DataFrame, content: str = "content", sample: int = SAMPLE, rounds: int = ROUNDS) -> dict[str, list[str]]:
    """Spans of a bounded sample that win clearly, by language (and code)."""
    rows = (
        df.select(F.col(content).alias("c")).where(F.length(F.trim("c")).between(9, SAMPLE_LENGTH))
        .select("c", F.xxhash64("c").alias("h")).orderBy("h", "c").limit(sample).select("c").collect()
    )
    return self_train([r["c"] for r in rows], rounds)


def _tail(spans: list[str]) -> list[str]:
    """As many of the last spans as a dictionary holds."""
    size, out = 0, []
    for s in reversed(spans):
        size += len(s.encode()) + 1
        if size > DICTIONARY_BYTES:
            break
        out.append(s)
    return out[::-1]


def self_train(texts: list[str], rounds: int = ROUNDS) -> dict[str, list[str]]:
    found = sorted({s for t in texts for s in spans(t)})
    more: dict[str, list[str]] = {}
    for _ in range(rounds):
        me, won = Identifier(more), defaultdict(list)
        for s in found:
            size = len(s.encode())
            costs = me.costs(s)
            code = costs.pop("code")
            order = sorted(costs.values())
            clear = len(order) < 2 or order[1] - order[0] >= 2
            if clear and order[0] <= 0.9 * size and code - order[0] >= 0.08 * size:
                won[min(costs, key=costs.get)].append(s.lower())
            elif code < 0.9 * size and code <= order[0] - 2:
                won["code"].append(s.lower())
        more = {lang: _tail(won_spans) for lang, won_spans in won.items()}
    return more


def identify(df: DataFrame, keep: tuple[str, ...] = ("id",), content: str = "content", more=None) -> DataFrame:
    """The kept columns with lang and n_natural for every text holding a sentence."""
    return measure(df, keep, content, more).where(F.col("lang").isNotNull()).drop("n_chars")


def measure(df: DataFrame, keep: tuple[str, ...] = ("id",), content: str = "content", more=None) -> DataFrame:
    """The kept columns of every text that is not blank, with lang (NULL without a sentence),
    n_natural (its characters of natural language) and n_chars (all its characters), both
    counted in what the spelling stands for."""
    workers_can_import(df.sparkSession)
    if more is None:
        more = fit(df, content)
    state: dict = {}

    names = [*keep, "lang", "n_natural", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "me" not in state:
            state["me"] = Identifier(more)
        me, seen = state["me"], {}
        for b in batches:
            out = []
            for t in b.column(b.num_columns - 1).to_pylist():
                got = seen.get(t)
                if got is None:
                    got = (*(me.text(t) or (None, 0)), len(unspell(t)))
                    if len(seen) < 100_000 and len(t) < 500:
                        seen[t] = got
                out.append(got)
            langs, natural, chars = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(langs, pa.string()), pa.array(natural, pa.int64()), pa.array(chars, pa.int64())], names=names)

    plain = df.select(*keep, F.col(content).alias("__text")).where(F.length(F.trim("__text")) > 0)
    schema = df.select(*keep).withColumn("lang", F.lit(None).cast("string")).withColumn("n_natural", F.lit(0).cast("long")).withColumn("n_chars", F.lit(0).cast("long")).schema
    return plain.mapInArrow(run, schema)
