"""Credentials embedded in source code: finding and redacting them.

A literal's raw spelling is undone with a map back to its positions (adjacent
pieces joined, escapes decoded) and cut into candidate values: tokens, bodies
of PEM blocks and passwords of URLs.  A logistic regression scores each
candidate from the likelihood of its characters under two character Markov
chains (harmless tokens, weakly labelled secrets), its surrounding identifiers
and the path it stands in.  Weak labels come from pattern matches; candidates
on which the patterns say nothing are left out of training.  Scores are
calibrated on a held-out part and cut at ``THRESHOLD``.

Only the fit looks at a bounded sample (``SAMPLE`` texts with the least
hashes, with their files and functions).  Scoring covers every row: candidates
are extracted in one Arrow pass without a shuffle, path features are joined to
the rows that these features can still lift over the threshold, and the linear
score is a column expression.

Values of any length are scored whole if a secret name announces them; others
from ``MIN_LENGTH`` characters on.

Defined results: NULL, empty and blank texts hold no secret; redaction replaces
each secret's characters by ``MARK``, once a secret, and keeps every other
character of the spelling, literal boundaries inside a broken-up secret
included.  An announced value is taken out up to the next blank, quote or
``name=``, separators inside it included.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.runtime import workers_can_import

SAMPLE = 20_000
#: longer texts are left out of the sample (never out of the result)
SAMPLE_LENGTH = 4_000
THRESHOLD = 0.5
MARK = "REDACTED"
#: least length of a value that no secret name announces
MIN_LENGTH = 6
RIDGE = 0.02

# Names that announce a secret, names that announce public data,
# stand-ins, and the published formats of well-known providers' keys.
SECRET_NAMES = set("""
password passwd passwort passphrase pass pwd psk pw secret token key apikey auth authorization bearer basic credential credentials
jwt hmac sig signature signing pin kennwort contraseña clave senha passe hasło wachtwoord lösenord пароль ключ 密码 口令 密钥 パスワード private accesskey
""".split())
STRONG_NAMES = SECRET_NAMES - {"key", "auth", "sig", "signature", "pin", "private", "pass", "clave"}
PUBLIC_NAMES = set("""
sha sha1 sha256 sha512 md5 crc crc32 etag commit rev revision digest checksum hash uuid guid public certificate fingerprint
build version png jpeg image base64 integrity page object blob tree oid
""".split())
STAND_IN = regex.compile(
    r"^(?:[x*.\-#?0_]+|<.*|\{.*|\[.*|\$.*|%.*|@.*@|\(.*)$|change.?me|placeholder|example|redacted|your[_\-. ]|dummy|replace|"
    r"to.?do|insert|sample|hidden|omitted|masked|^(?:none|null|undefined|empty|default|unset|string|secret|password|token|value)$|(.)\1{5,}", regex.I)
KNOWN = regex.compile(
    r"^(?:(?:AKIA|ASIA)[0-9A-Z]{12,20}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeoprs]-[\w-]{16,}|"
    r"[srp]k_(?:live|test)_\w{12,}|SG\.[\w-]{10,}\.[\w-]{10,}|AIza[\w-]{30,}|ya29\.[\w-]{20,}|npm_\w{30,}|hf_\w{20,}|shp\w{2}_\w{20,}|"
    r"dop_v1_\w{30,}|pypi-[\w-]{30,}|sk-[\w-]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,})$")

_PIECE = regex.compile(
    r'(?P<join>(?<!\\)"(?:\s|\\[ntrv])*")|(?P<hex>(?:\\x[0-9A-Fa-f]{2}|\\[0-7]{3})+)|\\u(?P<u4>[0-9A-Fa-f]{4})|\\(?P<simple>["\'\\?ntrabfv0])|(?P<char>[^\\"]+|.)',
    regex.S)
_BYTE = regex.compile(r"\\x([0-9A-Fa-f]{2})|\\([0-7]{3})")
_PEM = regex.compile(r"-----BEGIN ([A-Z0-9 ]{3,40})-----\s*([\s\S]*?)(?:-----END|$)")
_URL = regex.compile(r"\b[A-Za-z][\w+.\-]*://[^/\s:@\"']*:([^/\s@\"']+)@")
_PAIR = regex.compile(r"\b[A-Z]{2}[0-9a-f]{32}:([0-9a-f]{24,64})\b")
_TOKEN = regex.compile(r"[^\s\"';,&=:|]+=*")
_WORDS = regex.compile(r"\p{Lu}?[\p{Ll}\p{Lo}\p{M}]+|\p{Lu}+|\d+")
_UUID = regex.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", regex.I)
_HEX = regex.compile(r"^(?:0x)?[0-9a-f]{12,}$", regex.I)
_LETTERS = regex.compile(r"^[\p{L}\p{M}'’\-]+[.!?)>\]]*$")
_MIXED = regex.compile(r"\d|[A-Za-z][!@#$%^*?+_][A-Za-z]|[a-z][A-Z].*[a-z][A-Z]")
_INNER = regex.compile(r"[A-Za-z0-9][!@#$%^*?+_.\-][A-Za-z0-9]")
_PATHLIKE = regex.compile(r"^[\w.\-]*(?:[/\\]+[\w.\-?%{}<>*]*){1,}$|^\w+(?:\.[a-z_]+){1,5}$|^(?:\w+::)+\w+|^[\w.]+\([^)]*\)?;?$")

FEATURES = (
    "bias", "harmless_ll", "secret_ll", "ll_gap", "log_length", "digit_share", "mixed", "inner_sign", "hex", "uuid", "stand_in", "variety",
    "secret_name", "strong_name", "near_name", "public_name", "known_format", "pem_private", "pem_other", "url_password", "id_pair",
    "letters", "pathlike", "named_and_mixed", "unannounced", "path_test", "path_system", "function_names_secret",
)


def decode(raw: str) -> tuple[str, list[tuple[int, int]] | None]:
    """The text of a raw spelling and, per character, its raw range."""
    if "\\" not in raw and '"' not in raw:
        return raw, None
    out, at = [], []
    for m in _PIECE.finditer(raw):
        kind = m.lastgroup
        if kind == "join":
            continue
        if kind == "char":
            s, a = m[0], m.start()
            out.append(s)
            at += [(k, k + 1) for k in range(a, a + len(s))]
            continue
        elif kind == "hex":
            s = bytes(int(a, 16) if a else int(b, 8) & 255 for a, b in _BYTE.findall(m[0])).decode("utf-8", "replace")
        elif kind == "u4":
            s = chr(int(m["u4"], 16))
        else:
            s = {"n": "\n", "t": "\t", "r": "\r"}.get(m["simple"], m["simple"] if m["simple"] in "\"'\\?" else " ")
        out.append(s)
        at += [m.span()] * len(s)
    return "".join(out), at


def _names(tokens: list[str]) -> set[str]:
    found = set()
    for t in tokens:
        words = [w.lower() for w in _WORDS.findall(t)]
        found.update(words)
        found.update(a + b for a, b in zip(words, words[1:]))
    return found


#: what may follow a separator inside an announced value: no blank, no quote, no further name
_MORE = regex.compile(r"[;,&:|]+(?![\w.\-]*\s*[=:])[^\s\"';,&:|]+=*")


def reach(text: str, end: int) -> int:
    """Where a value that ends at ``end`` for its features really ends."""
    while m := _MORE.match(text, end):
        end = m.end()
    return end


def candidates(text: str) -> Iterator[tuple[int, int, str, list[str], str]]:
    """(start, end, value, names before it, kind) of every candidate value."""
    taken = []
    for m in _PEM.finditer(text):
        if len(m[2]) >= 24:
            taken.append(m.span())
            yield m.start(2), m.end(2), m[2], [m[1]], "pem_private" if "PRIVATE" in m[1] else "pem_other"
    if "://" in text:
        for m in _URL.finditer(text):
            taken.append(m.span())
            yield m.start(1), m.end(1), m[1], [], "url_password"
    for m in _PAIR.finditer(text):
        taken.append(m.span())
        yield m.start(1), m.end(1), m[1], [], "id_pair"
    before: list[str] = []
    for m in _TOKEN.finditer(text):
        value, start = m[0], m.start()
        # signs that wrap or end a value in prose or markup
        long_enough = len(value) >= MIN_LENGTH or bool(before) and bool(_names(before[-1:]) & SECRET_NAMES)
        if long_enough and not any(a <= start < b for a, b in taken):
            yield start, m.end(), value, before[-3:][::-1], ""
        before.append(value)


class Markov:
    """Bigram chain over characters with add-one smoothing."""

    def __init__(self, words: list[str]):
        pair, first = Counter(), Counter()
        for w in words:
            w = f"^{w}$"
            pair.update(zip(w, w[1:]))
            first.update(w[:-1])
        self.pair = {a + b: math.log((n + 0.5) / (first[a] + 48)) for (a, b), n in pair.items()}
        self.floor = {a: math.log(0.5 / (n + 48)) for a, n in first.items()}

    def mean(self, w: str) -> float:
        w = f"^{w}$"
        p, f = self.pair, self.floor
        total = 0.0
        for i in range(len(w) - 1):
            v = p.get(w[i : i + 2])
            total += v if v is not None else f.get(w[i], -4.5)
        return total / (len(w) - 1)


class Extractor:
    """Features of candidates, given the two chains."""

    def __init__(self, harmless: Markov, secret: Markov):
        self.harmless, self.secret = harmless, secret

    def features(self, value: str, names: list[str], kind: str) -> list[float]:
        v = value.strip(".,)>/]") or value
        a, b = self.harmless.mean(v), self.secret.mean(v)
        near = _names(names[:1])
        far = _names(names[1:])
        digit = sum(c.isdigit() for c in v) / len(v)
        mixed = float(any(c.isalpha() for c in v) and bool(_MIXED.search(v)))
        named = float(bool(near & SECRET_NAMES))
        return [
            1.0, a, b, b - a, math.log(len(v)), digit, mixed,
            float(bool(_INNER.search(v))),
            float(len(v) >= 12 and bool(_HEX.match(v))), float(len(v) == 36 and bool(_UUID.match(v))),
            float(bool(STAND_IN.search(value) or v != value and STAND_IN.search(v))), min(1.0, len(set(v)) / min(len(v), 16)),
            named, float(bool(near & STRONG_NAMES)), float(bool(far & SECRET_NAMES)),
            float(bool((near | far) & PUBLIC_NAMES)), float(bool(KNOWN.match(v))),
            *[float(kind == k) for k in ("pem_private", "pem_other", "url_password", "id_pair")],
            float(bool(_LETTERS.match(v))), float(bool(_PATHLIKE.match(v))),
            mixed * max(named, float(bool(far & STRONG_NAMES))),
            # nothing around the value or in its format says that it gives access
            float(not named and not far & SECRET_NAMES and not kind and not KNOWN.match(v)),
        ]


_AT = {n: i for i, n in enumerate(FEATURES)}


def weak_label(f: list[float], value: str) -> int | None:
    """1 or 0 where the patterns are sure, else None."""
    g = lambda n: f[_AT[n]]
    if g("pem_other") or g("stand_in") or g("uuid"):
        return 0
    if g("pem_private") or g("known_format") or g("id_pair"):
        return 1
    if g("url_password"):
        return 1 if g("mixed") else None
    if g("public_name") and not g("strong_name"):
        return 0
    if (g("strong_name") or (g("secret_name") and not g("pathlike"))) and g("mixed") and len(value) >= 8:
        return 1
    if g("letters") or (g("pathlike") and not g("secret_name")):
        return 0
    if not (g("secret_name") or g("near_name")):
        return 0
    return None


def _skip(value: str, names: list[str], kind: str) -> bool:
    """Plain words that no secret name precedes are not worth scoring."""
    return not kind and bool(_LETTERS.match(value)) and not (_names(names) & SECRET_NAMES)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float, steps: int = 40) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


class Model:
    """Fitted chains, weights and calibration; small and picklable."""

    def __init__(self, texts: list[str], places: list[tuple[float, float, float]] | None = None):
        """``places``: path_test, path_system and function_names_secret of each text."""
        places = places or [(0.0, 0.0, 0.0)] * len(texts)
        found = [(*c[2:], p) for t, p in zip(texts, places) for c in candidates(decode(t)[0])]
        blank = Extractor(Markov([]), Markov([]))
        first = [(v, n, k, p, weak_label(blank.features(v, n, k), v)) for v, n, k, p in found]
        seen = defaultdict(dict)
        for v, n, k, p, y in first:
            if y is not None:
                seen[y].setdefault((v, tuple(n[:1]), k, p), (v, n, k, p))
        # chains on one half, weights on the other, so that likelihoods are not remembered
        side = lambda v: sum(v.encode()) % 2
        words = {y: sorted({v.strip(".,)>/]") for v, _, _, _ in rows.values() if side(v) == 0}) for y, rows in seen.items()}
        self.extract = Extractor(Markov(words.get(0, [])), Markov(words.get(1, [])))
        rows = sorted([(v, n, k, p, y) for y, d in seen.items() for v, n, k, p in d.values() if side(v) == 1], key=lambda r: (r[0], r[4], r[2], r[3]))
        self.weights = np.zeros(len(FEATURES))
        self.weights[0] = -20.0
        if len({r[4] for r in rows}) < 2:
            self.a, self.b = 1.0, 0.0
            return
        x = np.array([[*self.extract.features(v, n, k), *p] for v, n, k, p, _ in rows])
        y = np.array([r[4] for r in rows], dtype=float)
        share = y.mean()
        w = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        fit = np.arange(len(y)) % 3 != 0
        self.weights = _logistic(x[fit], y[fit], w[fit], ridge=RIDGE)
        # Platt scaling on the held-out third
        s = x[~fit] @ self.weights
        cal = _logistic(np.stack([s, np.ones_like(s)], 1), y[~fit], w[~fit], ridge=0.1)
        self.a, self.b = float(max(cal[0], 0.05)), float(cal[1])
        self.held_out = float(((s * self.a + self.b > 0) == (y[~fit] == 1)).mean())


def _paths(files: DataFrame) -> DataFrame:
    """One row a file; rows of the same file repeat under other spellings."""
    path = F.lower("path")
    return files.groupBy(F.col("id").cast("long").alias("f")).agg(
        F.max(path.rlike(r"(^|/)(tests?|examples?|mocks?|fixtures?|samples?)(/|_)|_test\.").cast("double")).alias("path_test"),
        F.max(path.rlike(r"^/usr/|/include/").cast("double")).alias("path_system"),
    )


def _names_secret(function: str | None) -> float:
    return float(bool(_names([function or ""]) & STRONG_NAMES))


def fit(df: DataFrame, files: DataFrame, content: str = "content", sample: int = SAMPLE, file_id: str = "file_id", function: str = "function_usr") -> Model:
    """Train on the weak labels of a bounded sample, with the places it stands in."""
    picked = (
        df.select(F.col(content).alias("c"), F.col(file_id).cast("long").alias("f"), F.col(function).alias("u"))
        .where(F.length(F.trim("c")).between(1, SAMPLE_LENGTH))
        .select("c", "f", "u", F.xxhash64("c").alias("h")).orderBy("h", "c", "f", "u").limit(sample)
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    rows = picked.join(_paths(files), "f", "left").select("c", "h", "f", "u", zero("path_test"), zero("path_system")).collect()
    rows.sort(key=lambda r: (r["h"], r["c"], r["f"] or 0, r["u"] or ""))
    return Model([r["c"] for r in rows], [(r["path_test"], r["path_system"], _names_secret(r["u"])) for r in rows])


def score(
    df: DataFrame, files: DataFrame, model: Model | None = None, row_id: str = "id", content: str = "content",
    file_id: str = "file_id", function: str = "function_usr", least: float | None = None,
) -> DataFrame:
    """(id, spans, score) of every candidate: spans are its raw ranges.

    With ``least``, only candidates that may score that much or more come out.
    """
    workers_can_import(df.sparkSession)
    model = model or fit(df, files, content, file_id=file_id, function=function)
    extract = model.extract

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i, raw, file, fun in zip(*[c.to_pylist() for c in batch.columns]):
                got = seen.get(raw)
                if got is None:
                    text, at = decode(raw)
                    got = []
                    for start, end, v, names, kind in candidates(text):
                        if _skip(v, names, kind):
                            continue
                        if names and _names(names[:1]) & SECRET_NAMES:
                            end = reach(text, end)
                        ranges = [(start, end)] if at is None else _ranges(at, start, end)
                        got.append(([x for r in ranges for x in r], extract.features(v, names, kind)))
                    if len(seen) < 50_000 and len(raw) < 1000:
                        seen[raw] = got
                if got:
                    named = _names_secret(fun)
                    for spans, x in got:
                        for column, value in zip(out, (i, file, spans, [*x, named])):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["i", "f", "spans", "x"])

    plain = df.select(
        F.col(row_id).alias("i"), F.col(content).alias("c"), F.col(file_id).cast("long").alias("f"), F.col(function).alias("u")
    ).where(F.length(F.trim("c")) > 0)
    found = plain.mapInArrow(run, "i long, f long, spans array<int>, x array<double>")
    w = [float(v) for v in model.weights]
    inner = w[: len(FEATURES) - 3] + [w[-1]]
    dot = F.aggregate(
        F.zip_with("x", F.array(*[F.lit(v) for v in inner]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
    )
    found = found.select("i", "f", "spans", dot.alias("z"))
    if least is not None:
        # what no path can lift over the bound needs no path
        lift = max(0.0, w[-3]) + max(0.0, w[-2])
        found = found.where(F.lit(model.a) * (F.col("z") + F.lit(lift)) + F.lit(model.b) >= math.log(least / (1 - least)))
    z = F.col("z") + F.lit(w[-3]) * F.coalesce("path_test", F.lit(0.0)) + F.lit(w[-2]) * F.coalesce("path_system", F.lit(0.0))
    logit = F.lit(model.a) * z + F.lit(model.b)
    return found.join(_paths(files), "f", "left").select(
        F.col("i").alias(row_id), "spans", (1 / (1 + F.exp(-logit))).alias("score")
    )


def _ranges(at: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Raw ranges of characters start..end, joined where they touch."""
    out: list[list[int]] = []
    for a, b in at[start:end]:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def redact(raw: str, spans: list[int]) -> str:
    """The spelling with the given ranges of one secret taken out, and MARK where
    it begins, and again where text without a quote stands between two ranges."""
    ranges = _merged(zip(spans[::2], spans[1::2]))
    marks = {a for k, (a, _) in enumerate(ranges) if k == 0 or '"' not in raw[ranges[k - 1][1] : a]}
    return _cut(raw, ranges, marks)


def redact_all(raw: str | None, secrets: list[list[int]] | None) -> str | None:
    """The spelling with several secrets taken out, each with its MARK where it begins."""
    if raw is None or not secrets:
        return raw
    own = [_merged(zip(s[::2], s[1::2])) for s in secrets if s]
    ranges = _merged(r for x in own for r in x)
    starts = sorted({x[0][0] for x in own})
    # a secret that begins inside another one shares its mark
    return _cut(raw, ranges, {s for s in starts if any(a == s for a, _ in ranges)})


def _merged(ranges) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(raw: str, ranges: list[tuple[int, int]], marks: set[int]) -> str:
    out, last = [], 0
    for a, b in ranges:
        out += [raw[last:a], MARK if a in marks else ""]
        last = b
    return "".join([*out, raw[last:]])


def _redact_batch(raw: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([redact_all(t, s) for t, s in zip(raw.to_pylist(), spans.to_pylist())], pa.string())


def redacted(text: DataFrame, found: DataFrame, row_id: str = "id", content: str = "content") -> DataFrame:
    """(id, content) of the rows of ``text`` with a row in ``found`` (id, spans), redacted."""
    workers_can_import(text.sparkSession)
    # as many lists a row as it holds secrets
    spans = found.groupBy(row_id).agg(F.collect_list("spans").alias("__spans"))
    cut = F.arrow_udf(_redact_batch, "string")
    return text.select(row_id, content).join(spans, row_id).select(row_id, cut(content, "__spans").alias(content))
