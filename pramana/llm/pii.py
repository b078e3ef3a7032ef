"""Personal data by pattern and by a semi-Markov conditional random field.

The field scores whole candidate segments of up to ``MOST_TOKENS`` tokens by span features (shape,
check digits, octets, words around) and a dynamic program picks boundaries and kinds of a region
together. A segment has at most ``MOST_CHARS`` characters; what the patterns find has no limit. It is fitted in numpy on sentences made from a rule, and adds spans to those that the
patterns find.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.llm._spark import table, unused

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
MOST_TOKENS = 20
#: Characters of a candidate segment at most, and of those whose shape is remembered; characters that a task's memo holds.
MOST_CHARS, SHORT, MEMO = 2048, 64, 16_000_000
#: Tokens whose segments are held at a time.
BLOCK = 400
#: Sentences that the field is fitted on, and sweeps over them.
SENTENCES, SWEEPS = 300, 30
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: From the start of a run of digits only, and without giving digits back: what the plain pattern finds, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CORE = re.compile(r"[0-9@]+")
_OPENER = re.compile(r"[0-9@]+|[(\[](?:at|dot)[)\]]|AKIA|sk_|ghp_|(?:password|passwd|pwd|token|key|secret|apikey|api_key|credential)(?![a-z_])", re.I)
_TOKEN = re.compile(r"[^\W_]+|\s|.", re.S)
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _emails(text: str):
    """What finditer of the e-mail pattern gives, looking only around each @."""
    floor, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > floor and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            floor = m.end()
            yield a, floor
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches that pass their checks, in order."""
    if not _CORE.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m.group())]
    for kind, pattern in ((2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


#: Words before a value that tell its kind (fixed values).
_CUES = {
    "phone": "call phone tel telephone mobile fax cell ring".split(),
    "card": "card visa mastercard credit debit amex paid".split(),
    "ip": "ip host server address from".split(),
    "secret": "password passwd pwd token key secret apikey api_key credential".split(),
    "email": "email mail e contact write".split(),
}
_CUE = {w: k for k, v in enumerate(_CUES.values()) for w in v}
#: Characters before a segment that are searched for a cue.
_LOOK = 24
_WORD = re.compile(r"(?<![a-z_])[a-z_]+")
_OBFUSCATED = re.compile(r"[(\[]at[)\]]", re.I)
_FEATURES = 46


def _shape(s: str) -> tuple[int, ...]:
    """Numbers of the features that the text of a segment has by itself; those of short ones are remembered."""
    return _short_shape(s) if len(s) <= SHORT else _any_shape(s)


@lru_cache(maxsize=200_000)
def _short_shape(s: str) -> tuple[int, ...]:
    return _any_shape(s)


def _any_shape(s: str) -> tuple[int, ...]:
    digits = _NOT_DIGIT.sub("", s)
    n, letters = len(digits), sum(c.isalpha() for c in s)
    parts = [p for p in re.split(r"[^0-9]+", s) if p]
    f = [0]
    f += [1] * bool(_EMAIL.fullmatch(s)) + [2] * bool(_IP.fullmatch(s) and _octets(s))
    f += [3] * bool(_CARD.fullmatch(s) and 12 <= n <= 19) + [4] * (12 <= n <= 19 and luhn(digits) and not letters)
    f += [5] * bool(_PHONE.fullmatch(s) and 9 <= n <= 15)
    f += [6] * bool(re.fullmatch(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", s))
    f += [7] * (len(s) >= 16 and s.isalnum() and 0 < n < len(s)) + [8] * s.startswith(("AKIA", "sk_", "ghp_"))
    f += [9] * bool(re.fullmatch(r"[0-9a-f]{16,}", s) and letters > 0)
    f += [10 + min(n, 20) // 3]
    f += [17] * ("@" in s) + [18] * (letters == 0) + [19] * (len(parts) == 4) + [20] * (not s[0].isalnum() and s[0] not in "+(") + [21] * (not s[-1].isalnum())
    f += [22] * (" " in s) + [23] * ("." in s) + [24] * (s.isdigit()) + [25] * (len(s) < 7) + [26] * bool(re.fullmatch(r"(?i)[a-z0-9._-]+ ?(?:@|\(at\)|\[at\]) ?[a-z0-9-]+ ?(?:\.|\(dot\)|\[dot\]) ?[a-z]{2,}", s))
    f += [41] * (n == 0 and "@" not in s and not _OBFUSCATED.search(s))
    return tuple(f)


def _segments(text: str, tokens: list, low: int, high: int):
    """Candidate segments that start at the tokens low to high: (token from, token to) and the features of each."""
    segments, features = [], []
    for i in range(low, high):
        a = tokens[i][0]
        if text[a].isspace():
            continue
        before = text[a - 1] if a else " "
        # one character more, so that no rest of a cut word is taken for a cue
        near = text[max(0, a - _LOOK - 1) : a].lower()
        cue = next((_CUE[w] for w in reversed(_WORD.findall(near, a > _LOOK)[-2:]) if w in _CUE), None)
        given = cue == 4 and near.rstrip(" \"'")[-1:] in ("=", ":")
        equals = given and near[-1:] in ("=", '"', "'")
        for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
            b = tokens[j - 1][1]
            if b - a > MOST_CHARS:
                break
            s = text[a:b]
            if s[-1].isspace():
                continue
            after = text[b] if b < len(text) else " "
            f = list(_shape(s))
            f += [27] * (before.isalnum() or before in "@+_") + [28] * (after.isalnum() or after == "_") + [29] * (before in "=\"':")
            f += [30] * (before == "." or before == "-") + [31] * (after == "@" or (after in ".-" and b + 1 < len(text) and text[b + 1].isalnum()))
            f += [32 + (cue or 0)] * (cue is not None) + [37] * (j - i == 1) + [38] * (before == "(") + [39] * (before == "/") + [40] * (after == "%")
            whole = after.isspace() or after in "\"',;"
            f += [42] * equals + [43] * (41 in f and not given) + [44] * (41 in f and given and not equals) + [45] * (41 in f and whole)
            segments.append((i, j))
            features.append(f)
    x = np.zeros((len(segments), _FEATURES))
    for k, f in enumerate(features):
        x[k, f] = 1
    return segments, x


def _lattice(text: str, start: int = 0, end: int | None = None):
    """All candidate segments of a region with its tokens."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]
    return (tokens, *_segments(text, tokens, 0, len(tokens)))


def _examples(n: int, seed: int = 11):
    """Sentences with known spans, from a rule: filler words, values of each kind, and numbers that are none."""
    r = np.random.default_rng(seed)
    pick = lambda a: a[int(r.integers(len(a)))]
    plain = lambda: "".join(pick("bcdfglmnprst") + pick("aeiou") for _ in range(int(r.integers(1, 5))))
    digits = lambda k: "".join(str(d) for d in r.integers(0, 10, k))
    word = lambda: "".join(pick("bcdfglmnprst") + pick("aeiouéä") for _ in range(int(r.integers(1, 5))))
    draw = lambda letters, k: "".join(pick(letters) for _ in range(k))

    def card(sep):
        d = pick("345") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4)) if sep else d

    make = {
        0: lambda: pick([f"{plain()}{digits(2)}@{plain()}{digits(1)}.example.com", f"{plain()}.{plain()}@{plain()}.org", f"{plain()} (at) {plain()}{digits(1)} (dot) com", f"{plain()} (at) {plain()} (dot) com", f"{plain()} [at] {plain()} [dot] org", f"{plain()}@{plain()}-{plain()}.net"]),
        1: lambda: ".".join(str(int(x)) for x in r.integers(0, 256, 4)),
        2: lambda: card(pick(["", "", " ", "-"])),
        3: lambda: pick([f"+1 ({digits(3)}) 555-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(6)}"]),
        4: lambda: pick([lambda: "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 15) + "7", lambda: draw("0123456789abcdef", 19) + "a1", lambda: "sk_" + draw("abcdefghijkXYZ0123456789", 22) + "4"])(),
    }
    bare = [lambda: draw("abcdefghijkmnpqrstuvwxyz", 10), lambda: draw("abcdefghijkXYZQRS", 14), lambda: plain() + plain().title() + plain()]
    lead = {0: ["", "mail ", "email: "], 1: ["", "host ", "ip "], 2: ["", "card ", "visa: "], 3: ["", "call ", "phone: "], 4: ["", "password=", 'token = "', "key: "]}
    none = [lambda: digits(2), lambda: digits(4), lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"{digits(3)},{digits(3)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{word()}{digits(2)}", lambda: digits(7), lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"@{word()}", lambda: f"{pick(_CUES['secret'])} {word()}", lambda: f"{pick(_CUES['secret'])}: {word()}", lambda: f"({word()}) ", lambda: digits(24), lambda: f"{digits(3)}%"]
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(r.integers(1, 4))):
            text += " ".join(word() for _ in range(int(r.integers(1, 4)))) + " "
            if r.random() < 0.45:
                text += pick(none)()
            else:
                k = int(r.integers(5))
                cue = pick(lead[k])
                text += cue
                value = pick(bare)() if cue.endswith(("=", '"')) and r.random() < 0.5 else make[k]()
                spans.append((len(text), k, len(text) + len(value)))
                text += value + '"' * cue.endswith('"')
            text += pick([" ", ". ", ", ", " "])
        yield text + word(), spans


def _logsum(x: np.ndarray) -> float:
    m = x.max()
    return m + np.log(np.exp(x - m).sum())


@lru_cache(maxsize=1)
def fit(sentences: int = SENTENCES, sweeps: int = SWEEPS) -> np.ndarray:
    """Weights (kinds, features) by gradient ascent on the likelihood of the known segmentations."""
    k = len(KINDS)
    data, seen = [], np.zeros((k, _FEATURES))
    for text, spans in _examples(sentences):
        tokens, segments, x = _lattice(text)
        by = {(tokens[i][0], tokens[j - 1][1]): s for s, (i, j) in enumerate(segments)}
        gold = [(by[a, b], kind) for a, kind, b in spans if (a, b) in by]
        for s, kind in gold:
            seen[kind] += x[s]
        if segments:
            seg = np.array(segments)
            data.append((len(tokens), seg, x, [np.flatnonzero(seg[:, 1] == t) for t in range(len(tokens) + 1)], [np.flatnonzero(seg[:, 0] == t) for t in range(len(tokens) + 1)]))
    w, square = np.zeros((k, _FEATURES)), np.full((k, _FEATURES), 1e-8)
    for _ in range(sweeps):
        grad = seen - 0.3 * w
        for n, seg, x, ending, starting in data:
            score = x @ w.T
            inside = np.log(np.exp(score).sum(1))
            left, right = np.zeros(n + 1), np.zeros(n + 1)
            for t in range(1, n + 1):
                e = ending[t]
                left[t] = np.logaddexp(left[t - 1], _logsum(left[seg[e, 0]] + inside[e])) if len(e) else left[t - 1]
            for t in range(n - 1, -1, -1):
                e = starting[t]
                right[t] = np.logaddexp(right[t + 1], _logsum(right[seg[e, 1]] + inside[e])) if len(e) else right[t + 1]
            p = np.exp(score + (left[seg[:, 0]] + right[seg[:, 1]] - left[n])[:, None])
            grad -= p.T @ x
        square += grad**2
        w = w + 1.2 * grad / np.sqrt(square)
    return w


def decode(text: str, w: np.ndarray, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]]:
    """Best segmentation of a region: (start, kind, end) of the segments that are a kind.

    Candidates are made and scored a block of start tokens at a time, so that a long region needs no more memory
    than its tokens; the best value up to a token is final before segments from it are looked at.
    """
    tokens = [m.span() for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]
    n = len(tokens)
    best, back = [0.0] * (n + 1), [(-1, -1)] * (n + 1)
    for low in range(0, n, BLOCK):
        segments, x = _segments(text, tokens, low, min(n, low + BLOCK))
        score = x @ w.T
        kind = score.argmax(1)
        value = score[np.arange(len(kind)), kind]
        good = np.flatnonzero(value > 0)
        by_start: dict[int, list[int]] = {}
        for s in good.tolist():
            by_start.setdefault(segments[s][0], []).append(s)
        for i in range(low, min(n, low + BLOCK)):
            if i and best[i - 1] >= best[i]:
                best[i], back[i] = best[i - 1], (-1, -1)
            for s in by_start.get(i, ()):
                j, v = segments[s][1], best[i] + value[s]
                if v > best[j]:
                    best[j], back[j] = v, (i, int(kind[s]))
    if n and best[n - 1] >= best[n]:
        best[n], back[n] = best[n - 1], (-1, -1)
    out, t = [], n
    while t:
        i, k = back[t]
        if i < 0:
            t -= 1
        else:
            out.append((tokens[i][0], k, tokens[t - 1][1]))
            t = i
    return out[::-1]


def regions(text: str):
    """Parts of a text that can hold a value, in whole tokens: all that a segment can reach that holds a digit, @, (at),
    (dot) or a secret's first letters, or that a secret's cue stands before."""
    starts: list[int] = []
    start = end = reached = -1
    for m in _OPENER.finditer(text):
        a, b = m.span()
        if b <= end and not m.group()[0].isalpha() and bisect_right(starts, b - 1) == reached:
            continue  # in the token that the last one has looked at
        starts = starts or [t.start() for t in _TOKEN.finditer(text)]
        if m.group()[0].isalpha():
            b = min(len(text), a + _LOOK + 1)
        first = bisect_right(starts, a)
        reached = bisect_right(starts, b - 1)
        a = starts[max(0, first - MOST_TOKENS)]
        b = starts[reached - 1 + MOST_TOKENS] if reached - 1 + MOST_TOKENS < len(starts) else len(text)
        if a <= end:
            end = max(end, b)
            continue
        if start >= 0:
            yield start, end
        start, end = a, b
    if start >= 0:
        yield start, end


class Memo:
    """What the field found in parts of texts, up to ``MEMO`` characters of them."""

    def __init__(self):
        self.known: dict = {}
        self.held = 0

    def decode(self, text: str, w: np.ndarray, a: int, b: int) -> list[tuple[int, int, int]]:
        part = text[max(0, a - _LOOK - 1) : a], text[a:b], text[b : b + 2]
        got = self.known.get(part)
        if got is None:
            got = [(x - a, kind, y - a) for x, kind, y in decode(text, w, a, b)]
            if self.held + b - a > MEMO:
                self.known.clear()
                self.held = 0
            if b - a <= MEMO:
                self.known[part] = got
                self.held += b - a
        return got


def spans(text: str | None, w: np.ndarray, memo: Memo | None = None) -> tuple[list, list]:
    """Pattern spans, and these with the field's further spans; each (start, kind, end) in order."""
    text = text or ""
    base = base_spans(text)
    found = list(base)
    # pattern spans of different kinds may overlap: their union, in order; the field's own are disjoint
    froms: list[int] = []
    ends: list[int] = []
    for a, _, b in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            froms.append(a)
            ends.append(b)
    memo = memo or Memo()
    for a, b in regions(text):
        for x, kind, y in memo.decode(text, w, a, b):
            k = bisect_right(ends, a + x)
            if k == len(ends) or froms[k] >= a + y:
                found.append((a + x, kind, a + y))
    return base, sorted(found)


def _written(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row, repeated rows and those without an id too.

    Counts and the digest are of the pattern spans, ``spans`` has the field's as well. Positions are code points.
    Null and empty texts have none; an empty table gives an empty result. Ids may be of any type.
    """
    w = fit()

    def run(batches):
        memo = Memo()
        for b in batches:
            count, base, all_ = [], [], []
            for x in b.column(1):
                own, found = spans(x.as_py(), w, memo)
                count.append([sum(k == n for _, k, _ in own) for n in range(4)])
                base.append(hashlib.sha256(_written(own).encode()).hexdigest())
                all_.append(_written(found))
            n = np.array(count, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, i]) for i in range(4)), pa.array(base, pa.string()), pa.array(all_, pa.string())], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; null and empty texts stay, repeated rows too."""
    w = fit()
    names, own = docs.columns, unused(docs, "redacted")

    def run(batches):
        memo = Memo()
        for b in batches:
            out = []
            for x in b.column(own):
                text = x.as_py()
                if text is not None:
                    end = len(text)
                    merged: list[list] = []
                    for a, k, z in spans(text, w, memo)[1]:
                        if merged and a < merged[-1][2]:
                            merged[-1][2] = max(z, merged[-1][2])
                        else:
                            merged.append([a, k, z])
                    parts, at = [], 0
                    for a, k, z in merged:
                        parts += [text[at:a], f"[{KINDS[k].upper()}]"]
                        at = z
                    text = "".join([*parts, text[at:end]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == own else b.column(n) for n in b.schema.names], names=b.schema.names)

    source = docs.withColumnRenamed(text_col, own)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, schema).select(*[F.col(own).alias(n) if n == text_col else F.col(f"`{n}`") for n in names])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; see ``scan`` for nulls and repeats."""
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
