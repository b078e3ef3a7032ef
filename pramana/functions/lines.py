"""Step lines of chain texts, a batch of texts at a time: Arrow splits and matches, numpy places them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The parts of a step line, in order, and what may stand between two of them.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]*"
_GROUPS = [
    ("number", r"^\[", r"\d+", r"\]"),
    ("question", _SPACE + "Q:" + _SPACE, ".*?", _SPACE + r"\|"),
    ("answer", _SPACE + "A:" + _SPACE, ".*?", _SPACE + r"\|"),
    ("t0", _SPACE + "E:" + _SPACE + "t=", r"\d+", _SPACE + "-"),
    ("t1", _SPACE, r"\d+", _SPACE + r"box=\("),
    ("x0", _SPACE, r"[\d.]+", _SPACE + ","),
    ("y0", _SPACE, r"[\d.]+", _SPACE + ","),
    ("x1", _SPACE, r"[\d.]+", _SPACE + ","),
    ("y1", _SPACE, r"[\d.]+", _SPACE + r"\)"),
    ("deps", _SPACE + r"\|" + _SPACE + "deps=", r"[\d,\s\x1c-\x1f\x85\p{Z}]*", "$"),
]
_LINE = "".join(f"{before}(?P<{name}>{what}){after}" for name, before, what, after in _GROUPS)
_THINK = r"(?s)^(?P<before>.*?)<think>(?P<body>.*?)</think>"
_ANSWER = r"(?s)<answer>(?P<answer>.*?)</answer>"
#: Each ends a line; between the two characters of a line's end is a line without text.
_ENDS = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Numbers beyond this are no frames.
_LARGEST = 2**31 - 1
BOX = ("x0", "y0", "x1", "y1")
STEP = pa.struct([("question", pa.string()), ("answer", pa.string()), ("t0", pa.int32()), ("t1", pa.int32()), ("box", pa.struct([(n, pa.float64()) for n in BOX])), ("deps", pa.list_(pa.int32())), ("role", pa.string())])
PARSED = pa.struct([("chain", pa.list_(STEP)), ("answer", pa.string()), ("n_lines", pa.int32()), ("n_steps", pa.int32()), ("has_tags", pa.bool_())])
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _numpy(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def _lists(text_of: np.ndarray, n: int, values: pa.Array, kind: pa.DataType, missing: np.ndarray | None = None) -> pa.Array:
    """``values``, sorted by the text they belong to, as one list for each of ``n`` texts; null where ``missing``."""
    ends = np.searchsorted(text_of, np.arange(n + 1)).astype(np.int32)
    offsets = pa.array(ends, mask=None if missing is None else np.append(missing, False))
    return pa.ListArray.from_arrays(offsets, values, type=kind)


def _step_lines(texts: pa.Array):
    """For each text: is there a think tag, how many lines it holds; for each step line: its text, bounds and parts."""
    think = pc.extract_regex(texts, _THINK)
    tagged = _numpy(think.is_valid())
    body = pc.fill_null(pc.struct_field(think, "body"), "")
    at = _numpy(pc.utf8_length(pc.fill_null(pc.struct_field(think, "before"), ""))).astype(np.int64) + len("<think>")
    split = pc.split_pattern_regex(body, _ENDS)
    raw, owner = pc.list_flatten(split), _numpy(pc.list_parent_indices(split)).astype(np.int64)
    size = _numpy(pc.utf8_length(raw)).astype(np.int64)
    # a line begins after all before it in its text, each with its end
    past = np.concatenate([[0], np.cumsum(size + 1)])[:-1] if len(size) else size
    first = np.searchsorted(owner, np.arange(len(texts)))
    start = at[owner] + past - past[first[owner]] if len(size) else size
    start = start + size - _numpy(pc.utf8_length(pc.utf8_ltrim_whitespace(raw))).astype(np.int64)
    line = pc.utf8_trim_whitespace(raw)
    filled = _numpy(pc.greater(pc.utf8_length(line), 0)) & tagged[owner]
    n_lines = np.bincount(owner[filled], minlength=len(texts))
    parts = pc.extract_regex(line, _LINE)
    step = np.flatnonzero(_numpy(parts.is_valid()) & filled)
    taken = pa.array(step)
    end = start + _numpy(pc.utf8_length(line)).astype(np.int64)
    return tagged, n_lines, owner[step], start[step], end[step], parts.take(taken)


def step_spans(texts: pa.Array) -> pa.Array:
    """Start and end character of every step line inside the first think tag."""
    _, _, owner, start, end, _ = _step_lines(pc.fill_null(texts, ""))
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["start", "end"])
    return _lists(owner, len(texts), spans, SPANS)


def _checked(column: pa.Array, pattern: str, kind: pa.DataType, zero: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of the strings that match, with zero in the others' places, and which match."""
    good = pc.match_substring_regex(column, pattern)
    return _numpy(pc.if_else(good, column, zero).cast(kind)), _numpy(good)


def parse(texts: pa.Array) -> pa.Array:
    """Each text as PARSED. A step counts until one cannot be read; the chain is there if all can and are valid."""
    known = pc.fill_null(texts, "")
    n = len(texts)
    tagged, n_lines, owner, _, _, parts = _step_lines(known)
    field = lambda name: pc.struct_field(parts, name)
    answer = pc.utf8_trim_whitespace(pc.struct_field(pc.extract_regex(known, _ANSWER), "answer"))

    readable = np.ones(len(owner), bool)
    times, numbers = {}, {}
    for name in ("t0", "t1"):
        short = pc.replace_substring_regex(field(name), "^0+(.)", r"\1")
        times[name], good = _checked(short, r"^\d{1,10}$", pa.int64(), "0")
        readable &= good & (times[name] <= _LARGEST)
    for name in BOX:
        numbers[name], good = _checked(field(name), r"^(\d+\.?\d*|\.\d+)$", pa.float64(), "0")
        readable &= good

    # what a step names: the last step before it in its text with that number
    named = pc.split_pattern(field("deps"), ",")
    wanted, by = pc.utf8_trim_whitespace(pc.list_flatten(named)), _numpy(pc.list_parent_indices(named)).astype(np.int64)
    some = _numpy(pc.greater(pc.utf8_length(wanted), 0))
    wanted, by = wanted.filter(pa.array(some)), by[some]
    whole = _numpy(pc.match_substring_regex(wanted, r"^\d+$"))
    readable[by[~whole]] = False
    plain = lambda a: pc.replace_substring_regex(a, "^0+(.)", r"\1")
    both = pa.concat_arrays([plain(field("number")), plain(wanted)]).dictionary_encode()
    code = _numpy(both.indices).astype(np.int64)
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    _, group = np.unique(np.stack([np.concatenate([owner, owner[by]]), code]), axis=1, return_inverse=True)
    width = len(owner) + 1
    have = np.sort(group[: len(owner)] * width + place)
    want = group[len(owner) :] * width + place[by]
    found = np.searchsorted(have, want) - 1
    hit = (found >= 0) & (have[found] // width == want // width) if len(have) else np.zeros(len(want), bool)
    by, found = by[hit], have[found[hit]] % width
    order = np.lexsort((found, by))
    deps = _lists(by[order], len(owner), pa.array(found[order], pa.int32()), pa.list_(pa.int32()))

    question, said = (pc.utf8_trim_whitespace(field(c)) for c in ("question", "answer"))
    b = numbers
    valid = _numpy(pc.and_(pc.not_equal(question, ""), pc.not_equal(said, ""))) & (times["t1"] >= times["t0"])
    valid &= (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]) & np.logical_and.reduce([(v >= 0) & (v <= 1) for v in b.values()])
    broken = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(broken, owner[~readable], place[~readable])
    steps = np.bincount(owner, minlength=n)
    n_steps = np.where(broken < steps, broken + 1, steps)
    good = tagged & (steps > 0) & (broken >= steps) & _numpy(answer.is_valid()) & (np.bincount(owner[~valid], minlength=n) == 0)

    kept = np.flatnonzero(good[owner])
    boxes = pa.StructArray.from_arrays([pa.array(b[c][kept]) for c in BOX], names=list(BOX))
    at = pa.array(kept)
    columns = [question.take(at), said.take(at), pa.array(times["t0"][kept], pa.int32()), pa.array(times["t1"][kept], pa.int32()), boxes, deps.take(at), pa.nulls(len(kept), pa.string())]
    chain = _lists(owner[kept], n, pa.StructArray.from_arrays(columns, fields=list(STEP)), pa.list_(STEP), ~good)
    out = [chain, answer, pa.array(n_lines, pa.int32()), pa.array(n_steps, pa.int32()), pa.array(tagged)]
    return pa.StructArray.from_arrays(out, fields=list(PARSED), mask=texts.is_null())
