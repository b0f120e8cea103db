r"""Secrets in texts: fixed patterns, and a battery of randomness tests for unnamed keys.

Patterns (kinds assign, access, hex) find what looks like a secret by its form. Beyond
them, runs of 20 or more of [A-Za-z0-9+/_=-] are cut at inner '=' (name=value). A piece that
no encoding holds, or that as a whole is no random text, is also cut at '/' and '+', at '-'
and '_', and at all of these, so a value is found behind a name, prefix or path. Every piece
or part of 20 or more with a letter is a candidate:

* its encoding is inferred from the characters (hex, letters of
  one or both cases, base32, base36, base62, base64);
* tests ask if it could be uniform random text of that alphabet: chi-squared uniformity of
  the symbols (exact mean and variance of the statistic for its length), of the letters
  without regard to case, and of the shares of digits, vowels and consonants;
  Wald-Wolfowitz runs of the alphabet's lower and upper half, and runs of one class or one
  case; serial correlation at lag 1. Fisher's method sums the -log p: the evidence against
  randomness;
* false discoveries are held per stratum of encoding and length, since a short token gives
  weak evidence. How random tokens of the stratum are distributed is known from NULLS random
  ones. Twice the tokens below their median estimates the number of secrets; what exceeds
  them at higher evidence are the corpus's own ordinary tokens. Evidence ends at 0 and its
  distribution is a power of it there, so F(t), how many ordinary tokens reach t or less by
  chance, is continued as a power law from the least evidence that TAIL and 5 * TAIL of them
  show, fine enough for secrets that are rare among ordinary tokens. A stratum with too few
  of its own takes the estimate from NULLS made ordinary tokens (words, numbers and separators
  in the encoding's characters). With R(t) tokens of the stratum at t or less, the greatest t
  with F(t) <= q R(t) is the threshold; without one, nothing of the stratum is taken. The
  evidence of the whole corpus enters as counts in BINS bins, summed in Spark: a table of
  fixed size.

Tokens at or below their threshold that overlap no pattern's span become spans of kind
"random". Texts are scanned once, as bytes with numpy; only texts with a keyword, a long
run or a candidate are decoded for the regular expressions, whole. Null text is empty; an
empty table gives no rows; repeated rows are scanned alike; other columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store
from .words import LOWER, text_blocks, token_spans

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

MIN_TOKEN = 20
RATE = 0.05
BINS = 200
NULLS = 2000
TAIL = 10
TESTS = 7
#: Upper edges of the bins of evidence.
EDGES = np.geomspace(0.5, -TESTS * math.log(1e-12), BINS)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
#: A piece between '='; those at the end of a run are padding.
_PIECE = re.compile(r"[A-Za-z0-9+/_-]+(?:=+$)?")
_CUTS = tuple(map(re.compile, ("[^/+]+", "[^_-]+", "[^/+_-]+")))
#: A piece with a p-value below is looked at in parts.
WHOLE = 0.01


def _set(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_DIGITS, _LOWERS, _UPPERS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOKEN_BYTES = _set(_DIGITS + _LOWERS + _UPPERS + "+/_=-")
_HEX_BYTES = _set(_DIGITS + "abcdef")
#: Encodings by alphabet, the first that holds all of a token's characters counts.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("UPPER", _UPPERS),
    ("lower", _LOWERS),
    ("letters", _UPPERS + _LOWERS),
    ("base32", _UPPERS + "234567"),
    ("base36", _DIGITS + _LOWERS),
    ("BASE36", _DIGITS + _UPPERS),
    ("base62", _UPPERS + _LOWERS + _DIGITS),
    ("base64", _UPPERS + _LOWERS + _DIGITS + "+/"),
    ("base64url", _UPPERS + _LOWERS + _DIGITS + "-_"),
)


def _class(ch: str) -> int:
    """Digit, vowel or consonant of either case, or sign."""
    return 0 if ch in _DIGITS else (1 if ch in "aeiou" else 2) if ch in _LOWERS else (3 if ch in "AEIOU" else 4) if ch in _UPPERS else 5


_GROUP = np.array([0, 1, 1, 2, 2, 3])
#: What share of an encoding's alphabet each class has.
_SHARES = {name: np.bincount([_class(c) for c in alphabet], minlength=6) / len(alphabet) for name, alphabet in ENCODINGS}
_INDEX = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS}


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _fisher(half: float, tests: int = TESTS) -> float:
    """The combined p-value of a sum of -log p over the tests."""
    return min(1.0, math.exp(-half) * sum(half**i / math.factorial(i) for i in range(tests)))


def randomness(token: str) -> tuple[str, float] | None:
    """(stratum, combined p-value that the token is uniform random); None without an encoding."""
    found = _evidence(token)
    return found and (found[0], _fisher(found[1]))


def _evidence(token: str) -> tuple[str, float] | None:
    """(stratum, sum of -log p over the battery); None without an encoding."""
    body = token.rstrip("=")
    name = next((n for n, x in _INDEX.items() if all(c in x for c in body)), None)
    if name is None or len(body) < MIN_TOKEN or not any(c.isalpha() for c in body):
        return None
    x = np.array([_INDEX[name][c] for c in body])
    n, k = len(x), len(_INDEX[name])
    counts = np.bincount(x, minlength=k)
    chi = float((counts.astype(float) ** 2).sum() * k / n - n)
    p1 = _upper((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = x >= k / 2
    n1 = int(high.sum())
    n0 = n - n1
    if n0 and n1:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * n0 * n1 / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p2 = 2 * _upper(abs(runs - mean) / math.sqrt(var))
    else:
        p2 = 2.0 ** (1 - n)
    c = x - x.mean()
    r = float((c[1:] * c[:-1]).sum() / max(float((c * c).sum()), 1e-9))
    p3 = 2 * _upper(abs(r + 1 / n) * math.sqrt(n))
    kind = np.array([_class(ch) for ch in body])
    share = _SHARES[name]
    seen = np.bincount(kind, minlength=len(share))
    used = share > 0
    chi = float(((seen - n * share)[used] ** 2 / (n * share[used])).sum())
    df = max(int(used.sum()) - 1, 1)
    p4 = _upper(((chi / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))  # Wilson-Hilferty
    same, q = int((kind[1:] == kind[:-1]).sum()), float((share**2).sum())
    p5 = 2 * _upper(abs(same - (n - 1) * q) / math.sqrt((n - 1) * q * (1 - q)))
    kind, share = _GROUP[kind], np.bincount(_GROUP, share, 4)  # digits, lower case, upper case, signs
    same, q = int((kind[1:] == kind[:-1]).sum()), float((share**2).sum())
    p6 = _upper((same - (n - 1) * q) / math.sqrt((n - 1) * q * (1 - q))) if q < 1 else 1.0
    letters = np.array([ord(c) - 97 for c in body.lower() if c.isalpha()])
    m, p7 = len(letters), 1.0
    if m > 1 and k > 26 and not name.startswith(("hex", "HEX")):
        chi = float((np.bincount(letters, minlength=26).astype(float) ** 2).sum() * 26 / m - m)
        p7 = _upper((chi - 25) / math.sqrt(50 * (m - 1) / m))
    tests = (p1, p2, p3, p4, p5, p6, p7)
    half = -sum(math.log(min(max(p, 1e-12), 1.0)) for p in tests)
    step = max(n.bit_length() - 3, 0)
    return f"{name}/{min(n >> step << step, 128)}", half


def _candidates(run: str) -> list[tuple[int, int, str, float]]:
    """(start, end, stratum, evidence) of what is judged in a run of token characters; without overlaps."""
    out = []
    for m in _PIECE.finditer(run):
        piece, at = m[0], m.start()
        if len(piece) < MIN_TOKEN:
            continue
        whole = _evidence(piece)
        if whole and _fisher(whole[1]) >= WHOLE:
            out.append((at, m.end(), *whole))
            continue
        parts = {}
        for cut in _CUTS:
            for c in cut.finditer(piece):
                if MIN_TOKEN <= len(c[0]) < len(piece) and c.span() not in parts and (found := _evidence(c[0])):
                    parts[c.span()] = found
        # Random parts first, the longest of them; the others are judged as they are.
        taken: list[tuple[int, int]] = []
        for (s, e), found in sorted(parts.items(), key=lambda x: (_fisher(x[1][1]) < WHOLE, x[0][0] - x[0][1], x[0])):
            if all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
                out.append((at + s, at + e, *found))
        if whole and not taken:
            out.append((at, m.end(), *whole))
    return sorted(out)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str, float]]]:
    """(pattern spans (start, end, kind index)), (candidates (start, end, stratum, evidence)) of one text, in code points."""
    base = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if len(m[0]) >= 24]
    base.sort(key=lambda s: (s[0], s[2]))
    more = []
    for m in _TOKEN.finditer(text):
        for a, b, *found in _candidates(m[0]):
            a, b = m.start() + a, m.start() + b
            if not any(s < b and e > a for s, e, _ in base):
                more.append((a, b, *found))
    return base, more


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of a block that hold anything that scan() could find."""
    at = [np.zeros(0, np.int64)]
    s, e = token_spans(data, offsets, _TOKEN_BYTES)
    at.append(s[e - s >= MIN_TOKEN])
    s, e = token_spans(data, offsets, _HEX_BYTES)
    at.append(s[e - s >= 24])
    plain, lower = data.tobytes(), LOWER[data].tobytes()
    for word, where in [(w, lower) for w in _KEYWORDS] + [(b"AKIA", plain)]:
        i = where.find(word)
        while i >= 0:
            at.append(np.array([i]))
            i = where.find(word, i + 1)
    return np.unique(np.searchsorted(offsets, np.concatenate(at), "right") - 1)


_SPAN = "array<struct<kind: int, start: int, stop: int, stratum: string, evidence: double>>"


def find_candidates(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """doc_id (and `extra` columns) with `found`: pattern spans (evidence null) and candidates, as structs."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("stratum", pa.string()), ("evidence", pa.float64())]))
    keep = ["doc_id", *(extra or [])]
    types = dict((f.name, f.dataType.simpleString()) for f in docs.schema.fields)

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            found: list[list] = [[] for _ in range(b.num_rows)]
            for a, _, data, offs in text_blocks(texts):
                for i in _suspects(data, offs):
                    base, more = scan(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
                    found[a + i] = [{"kind": k, "start": s, "stop": e, "stratum": None, "evidence": None} for s, e, k in base] + [{"kind": 3, "start": s, "stop": e, "stratum": g, "evidence": x} for s, e, g, x in more]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(found, kind)], [*keep, "found"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + f", found {_SPAN}")


# Common words, of which ordinary long tokens are made.
_COMMON = (
    "the and for that with this from have not are was you they which will would there their what about more when can time people year work first after good new over think also back "
    "use two how our way even want because any these give day most file index page data user name test report image main list item system public release version value number group table "
    "order state story house world point water money month right study book word side kind head business service friend father power hour game line end member law car city community"
).split()


def _ordinary(name: str, length: int, rng: random.Random) -> str:
    """A token of ordinary text in an encoding's characters."""
    if name in ("hex", "HEX"):
        run = "".join(rng.choice(_DIGITS) if rng.random() < 0.85 else rng.choice("abcdef") for _ in range(length))
        return run.upper() if name == "HEX" else run
    joiner = {"base64": "/", "base64url": "-"}.get(name, "")
    out = ""
    while len(out) < length:
        word = rng.choice(_COMMON) if name in ("UPPER", "lower", "letters") or rng.random() < 0.8 else str(rng.randrange(1990, 2030) if rng.random() < 0.5 else rng.randrange(100))
        word = word.upper() if name in ("UPPER", "base32", "BASE36") else word.capitalize() if name in ("letters", "base62") else word
        out += (joiner if out else "") + word
    out = out[:length]
    return "".join(c if c in _INDEX[name] else "2" for c in out)


def _lengths(stratum: str) -> tuple[str, int, int]:
    """The encoding, and the least and greatest length of a stratum (300 stands for no end)."""
    name, band = stratum.split("/")
    least = int(band)
    return name, least, least + (1 << max(least.bit_length() - 3, 0)) - 1 if least < 128 else 300


def _made(stratum: str, token) -> np.ndarray:
    """Sorted evidence of NULLS tokens of the stratum; token(encoding, length, rng) makes one."""
    name, least, most = _lengths(stratum)
    rng = random.Random(stratum)
    found = []
    while len(found) < NULLS:
        t = token(name, rng.randint(least, most), rng)
        got = _evidence(t if any(c.isalpha() for c in t) else "a" + t[1:])
        found.append(got[1] if got else math.inf)
    return np.sort(np.maximum(found, 1e-9))


@lru_cache(maxsize=None)
def _random_share(stratum: str) -> np.ndarray:
    """Share of random tokens of the stratum up to each of EDGES."""
    alphabets = dict(ENCODINGS)
    return np.searchsorted(_made(stratum, lambda name, n, rng: "".join(rng.choices(alphabets[name], k=n))), EDGES, "right") / NULLS


def _power(low: float, n_low: float, high: float, n_high: float) -> float:
    return max(1.0, math.log(n_high / n_low) / math.log(high / low))


@lru_cache(maxsize=None)
def _made_share(stratum: str) -> np.ndarray:
    """Share of ordinary tokens of the stratum up to each of EDGES, from made ones."""
    x = _made(stratum, _ordinary)
    low, high = x[TAIL - 1], x[5 * TAIL - 1]
    tail = TAIL / NULLS * (EDGES / low) ** _power(low, 1, high, 5)
    return np.where(low > EDGES, tail, np.searchsorted(x, EDGES, "right") / NULLS)


def _false(stratum: str, counts: np.ndarray) -> np.ndarray:
    """Ordinary tokens up to each of EDGES, by chance; counts: tokens of the stratum in each bin."""
    seen, share = counts.cumsum(), _random_share(stratum)
    median = min(int(np.searchsorted(share, 0.5)), BINS - 1)
    secrets = seen[median] / max(share[median], 0.5)
    due = secrets * share
    ordinary = seen - due
    sure = np.flatnonzero(ordinary - 2 * np.sqrt(due) >= TAIL)
    low = sure[0] if len(sure) else None
    high = low is not None and next((k for k in range(low + 1, BINS) if ordinary[k] >= 5 * ordinary[low]), None)
    if high:
        tail = ordinary[low] * (EDGES / EDGES[low]) ** _power(EDGES[low], ordinary[low], EDGES[high], ordinary[high])
        return np.where(np.arange(BINS) < low, tail, np.maximum(ordinary, tail))
    return max(seen[-1], 1.0) * _made_share(stratum)


def thresholds(found: DataFrame, rate: float = RATE) -> dict[str, float]:
    """The greatest accepted evidence of each stratum (-1: none); counts of all candidates in BINS bins."""
    each = found.select(F.explode(F.filter("found", lambda s: s["evidence"].isNotNull())).alias("s"))
    step = math.log(EDGES[1] / EDGES[0])
    bin = F.ceil(F.log(F.greatest(F.col("s.evidence"), F.lit(1e-9)) / float(EDGES[0])) / step - 1e-9)
    bin = F.greatest(F.least(bin, F.lit(BINS - 1)), F.lit(0)).cast("int")
    rows = each.groupBy("s.stratum", bin.alias("bin")).count().collect()  # at most encodings x length bands x BINS rows
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r["stratum"], np.zeros(BINS))[r["bin"]] += r["count"]
    out = {}
    for g, c in counts.items():
        ok = np.flatnonzero(_false(g, c) <= rate * c.cumsum())
        ok = ok[c.cumsum()[ok] > 0]
        out[g] = float(EDGES[ok[-1]]) if len(ok) else -1.0
    return out


def find_secrets(docs: DataFrame, extra: list[str] | None = None, rate: float = RATE, store: Store | None = None) -> DataFrame:
    """Per row: doc_id, `extra` columns and spans array<struct<kind: int, start: int, stop: int>>, by start, then kind."""
    found = (store or Store(docs.sparkSession)).keep(find_candidates(docs, extra))
    least = thresholds(found, rate)
    limit = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else F.create_map(F.lit(""), F.lit(-1.0))
    kept = F.filter("found", lambda s: s["evidence"].isNull() | (s["evidence"] <= limit[s["stratum"]]))
    spans = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return found.select("doc_id", *(extra or []), F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))


def redact(docs: DataFrame, rate: float = RATE, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span (merged where they overlap) of its texts replaced by `mark`.

    All columns pass; an `n_chars` column counts the new text. Texts without a span stay as
    they are, null ones too. Two scans: candidates' evidence for the thresholds, then the
    replacement, so no text is shuffled or written in between.
    """
    most = thresholds(find_candidates(docs.select("doc_id", "text")), rate)
    at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            texts, changed = b.column(at), {}
            for a, _, data, offs in text_blocks(texts):
                for i in _suspects(data, offs):
                    text = data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")
                    base, more = scan(text)
                    spans = sorted([(s, e) for s, e, _ in base] + [(s, e) for s, e, g, x in more if x <= most.get(g, -1.0)])
                    out, done = [], 0
                    for s, e in spans:
                        if s >= done:
                            out += [text[done:s], mark]
                        done = max(done, e)
                    if spans:
                        changed[a + int(i)] = "".join([*out, text[done:]])
            if changed:
                rows = pa.array([i in changed for i in range(b.num_rows)])
                new = [changed[i] for i in sorted(changed)]
                b = b.set_column(at, b.schema.field(at), pa.compute.replace_with_mask(texts, rows, pa.array(new, texts.type)))
                if size_at is not None:
                    old = b.column(size_at)
                    b = b.set_column(size_at, b.schema.field(size_at), pa.compute.replace_with_mask(old, rows, pa.array([len(t) for t in new], old.type)))
            yield b

    return docs.mapInArrow(run, docs.schema)


def labels(spans: str, kinds: tuple[str, ...] = KINDS):
    """Column: "kind:start:end" of each span, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")
