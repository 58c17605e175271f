"""Loading raw review records: typed rows for the valid ones, a reason and an offset for the others.

A finite-state tokenizer runs over the bytes of whole Arrow batches. Records are cut into chunks of CHUNK bytes; each
chunk is first run from every start state at once, which gives its transition function; the functions of the chunks
before it, composed in a doubling scan, then give the state in which each chunk really begins, so that long records
are tokenized in pieces side by side and quotes are seen across chunk borders. Nothing loops over rows in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 256
#: Chunks looked at together.
CHUNKS = 8192
#: Bytes of records tokenized together; bounds the working memory of a task.
GROUP_BYTES = 4_000_000

#: Field names, in the order of the columns of a line.
FIELDS = ("product/productId", "review/helpfulness", "review/score", "review/text")
#: Reasons for rejection, in the order in which they apply.
REASONS = ("empty", "no_separator", "quoting", "field_count", "helpfulness", "score", "text")
#: The largest denominator of a helpfulness.
MAX_DEN = 32767

# byte classes
OTHER, QUOTE, COMMA, BLANK, LF, COLON, PAD = range(7)
CLASS = np.zeros(256, np.uint8)
for byte, kind in ((b'"', QUOTE), (b",", COMMA), (b" ", BLANK), (b"\t", BLANK), (b"\r", BLANK), (b"\n", LF), (b":", COLON)):
    CLASS[byte[0]] = kind

# states of a line; of a block: LINE_START, NO_COLON, COLON_SEEN and BROKEN
COL_START, PLAIN, QUOTED, QUOTE_END, AFTER, BROKEN = range(6)
LINE_START, NO_COLON, COLON_SEEN = 0, 1, 2
STATES = 6


def _tables() -> np.ndarray:
    """next state by [layout (0 line, 1 block), byte class, state]"""
    t = np.tile(np.arange(STATES, dtype=np.uint8), (2, 7, 1))
    line, block = t
    for kind in (OTHER, COLON):
        line[kind, [COL_START, QUOTE_END, AFTER]] = [PLAIN, BROKEN, BROKEN]
    line[QUOTE, [COL_START, PLAIN, QUOTED, QUOTE_END, AFTER]] = [QUOTED, BROKEN, QUOTE_END, QUOTED, BROKEN]
    line[COMMA, [COL_START, PLAIN, QUOTE_END, AFTER]] = COL_START
    for kind in (BLANK, LF):
        line[kind, QUOTE_END] = AFTER
    for kind in (OTHER, QUOTE, COMMA):
        block[kind, LINE_START] = NO_COLON
    block[COLON, [LINE_START, NO_COLON]] = COLON_SEEN
    block[LF, [NO_COLON, COLON_SEEN]] = [BROKEN, LINE_START]
    return t


NEXT = _tables()


def chunk_functions(classes: np.ndarray, layout: np.ndarray) -> np.ndarray:
    """For each chunk the state after it, by the state before it."""
    run = np.tile(np.arange(STATES, dtype=np.uint8), (len(classes), 1))
    for j in range(classes.shape[1]):
        run = NEXT[layout[:, None], classes[:, j, None], run]
    return run


def chunk_starts(run: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The state in which each chunk begins; nth: the number of the chunk in its record, whose chunks are in a row."""
    step = 1
    while len(nth) and step <= nth.max():
        late = np.flatnonzero(nth >= step)
        run[late] = np.take_along_axis(run[late], run[late - step], 1)
        step *= 2
    start = np.zeros(len(nth), np.uint8)
    late = np.flatnonzero(nth > 0)
    start[late] = run[late - 1, 0]
    return start


def tokenize(data: np.ndarray, begin: np.ndarray, end: np.ndarray, layout: np.ndarray, chunk: int = CHUNK):
    """(at, record, delimiter, first broken offset or -1, last state) of the records data[begin:end]

    at, record: the places that cut a record into columns (line: commas) or into names and values (block: the first
    colon of each line, and line ends), in order; delimiter: the byte class there. Chunks are looked at CHUNKS at a
    time, so that the memory for them is bounded whatever the length of a record.
    """
    chunks = np.maximum(-(-(end - begin) // chunk), 1)
    rec = np.repeat(np.arange(len(begin)), chunks)
    nth = np.arange(len(rec)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    blocks = [slice(a, a + CHUNKS) for a in range(0, len(rec), CHUNKS)]

    def seen(part: slice) -> tuple[np.ndarray, np.ndarray]:
        place = (begin[rec[part]] + nth[part] * chunk)[:, None] + np.arange(chunk)
        inside = place < end[rec[part]][:, None]
        kinds = CLASS[data[np.minimum(place, len(data) - 1)]] if len(data) else np.zeros(place.shape, np.uint8)
        return place, np.where(inside, kinds, PAD).astype(np.uint8)

    run = np.empty((len(rec), STATES), np.uint8)
    for part in blocks:
        run[part] = chunk_functions(seen(part)[1], layout[rec[part]])
    starts = chunk_starts(run, nth)
    bad, last = np.full(len(begin), -1, np.int64), np.zeros(len(begin), np.uint8)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for part in blocks:
        place, classes = seen(part)
        own, state = rec[part], starts[part]
        kind = layout[own]
        cut, broke = np.zeros(classes.shape, bool), np.zeros(classes.shape, bool)
        for j in range(chunk):
            c = classes[:, j]
            now = NEXT[kind, c, state]
            cut[:, j] = np.where(kind == 0, (c == COMMA) & (now == COL_START), ((c == COLON) & (state != COLON_SEEN) & (now == COLON_SEEN)) | (c == LF))
            broke[:, j] = (now == BROKEN) & (state != BROKEN)
            state = now
        last[own] = state  # the last chunk of a record is written last
        where = np.nonzero(broke)
        bad[own[where[0]]] = place[where] - begin[own[where[0]]]
        where = np.nonzero(cut)
        found.append((place[where], own[where[0]], classes[where]))
    at, owner, what = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    return at, owner, what, bad, last


def _between(data: pa.Buffer, edges: np.ndarray) -> pa.Array:
    """The strings between edges[0], edges[1], edges[2], ...; edges ascend."""
    return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), data)


TRIM = " \t\r\n"


def _fields(records: pa.Array, layout: np.ndarray) -> dict:
    """Of every record: reason code or -1, offset, and the four values (null where there is no such value)."""
    n = len(records)
    records = records.cast(pa.string())
    edges = np.frombuffer(records.buffers()[1], np.int32, n + 1, records.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    buffer = records.buffers()[2] or pa.py_buffer(b"")
    data = np.frombuffer(buffer, np.uint8)
    begin, end = edges[:-1], edges[1:]
    at, rec, what, bad, last = tokenize(data, begin, end, layout)
    reason, offset = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    take = np.full((n, 4), -1, np.int64)  # where in `values` the fields are

    # a line: k commas make k + 1 columns
    line = layout == 0
    wrong = line & ((bad >= 0) | (last == QUOTED))
    reason[wrong] = 2
    offset[wrong] = np.where(bad >= 0, bad, end - begin)[wrong]
    commas = np.bincount(rec, minlength=n)
    few = line & ~wrong & (commas != 3)
    reason[few], offset[few] = 3, (end - begin)[few]
    good = line & (reason < 0)
    cuts = at[good[rec]]
    rows = np.flatnonzero(good)
    inner = cuts.reshape(-1, 3)
    marks = np.column_stack([begin[rows], inner[:, 0], inner[:, 0] + 1, inner[:, 1], inner[:, 1] + 1, inner[:, 2], inner[:, 2] + 1, end[rows]]).ravel() if len(rows) else np.zeros(0, np.int64)
    line_values = _between(buffer, marks).take(pa.array(np.arange(0, len(marks) - 1, 2))) if len(marks) else pa.array([], pa.string())
    line_values = pc.utf8_trim(line_values, TRIM)
    quoted = pc.starts_with(line_values, '"')
    line_values = pc.if_else(quoted, pc.replace_substring(pc.utf8_slice_codeunits(line_values, 1, -1), '""', '"'), line_values)
    take[rows] = np.arange(len(line_values)).reshape(-1, 4)

    # a block: a first colon and a line end in turn, in lines that aren't blank
    block = layout == 1
    unended = block & (bad < 0) & (last == NO_COLON)
    wrong = block & ((bad >= 0) | unended)
    reason[wrong] = 1
    offset[wrong] = np.where(bad >= 0, bad, end - begin)[wrong]
    colon = (what == COLON) & (block & ~wrong)[rec]
    here, owner = at[colon], rec[colon]
    ends_at = at[what == LF]
    k = np.searchsorted(ends_at, here)
    stop = np.minimum(ends_at[np.minimum(k, max(len(ends_at) - 1, 0))] if len(ends_at) else end[owner], end[owner]) if len(here) else here
    if len(ends_at):
        stop = np.where(k < len(ends_at), stop, end[owner])
    prev = np.where(k > 0, ends_at[np.maximum(k - 1, 0)] + 1, 0) if len(ends_at) else np.zeros(len(here), np.int64)
    start = np.maximum(prev, begin[owner])
    marks = np.column_stack([start, here, here + 1, stop]).ravel() if len(here) else np.zeros(0, np.int64)
    parts = _between(buffer, marks) if len(marks) else pa.array([], pa.string())
    names = parts.take(pa.array(np.arange(0, len(marks) - 1, 4))) if len(marks) else parts
    block_values = parts.take(pa.array(np.arange(2, len(marks) - 1, 4))) if len(marks) else parts
    field = pc.index_in(names, pa.array(FIELDS)).fill_null(-1).to_numpy(zero_copy_only=False) if len(names) else np.zeros(0, np.int64)
    known = field >= 0
    times = np.zeros((n, 4), np.int64)
    np.add.at(times, (owner[known], field[known]), 1)
    wrong = block & (reason < 0) & (times != 1).any(1)
    reason[wrong], offset[wrong] = 3, (end - begin)[wrong]
    take[owner[known], field[known]] = len(line_values) + np.flatnonzero(known)
    take[reason >= 0] = -1
    values = pa.concat_arrays([line_values, pc.utf8_trim(block_values, TRIM)])
    picked = [values.take(pa.array(take[:, i], mask=take[:, i] < 0)) for i in range(4)]
    return {"reason": reason, "offset": offset, "values": picked}


def _typed(records: pa.Array, layout: np.ndarray) -> list[pa.Array]:
    blank = np.asarray(pc.match_substring_regex(records, r"^[ \t\r\n]*$").fill_null(True))
    got = _fields(records.fill_null(""), layout)
    reason, offset, (pid, help_, score, text) = got["reason"], got["offset"], got["values"]
    reason[blank], offset[blank] = 0, 0

    def reject(ok: pa.Array, code: int) -> None:
        failed = (reason < 0) & ~np.asarray(ok.fill_null(False))
        reason[failed] = code

    parts = pc.extract_regex(help_, r"^[ \t]*0*(?P<n>[0-9]*?)[ \t]*/[ \t]*0*(?P<d>[0-9]*?)[ \t]*$")
    shaped = pc.match_substring_regex(help_, r"^[ \t]*[0-9]+[ \t]*/[ \t]*[0-9]+[ \t]*$")

    def number(name: str) -> pa.Array:
        digits = pc.struct_field(parts, name)
        short = pc.less_equal(pc.utf8_length(digits), 5)
        digits = pc.if_else(short, digits, "99999")  # above any limit
        return pc.if_else(pc.equal(digits, ""), "0", digits).cast(pa.int32())

    num, den = number("n"), number("d")
    fits = pc.and_(pc.less_equal(num, den), pc.less_equal(den, MAX_DEN))
    reject(pc.and_(shaped, fits), 4)
    reject(pc.match_substring_regex(score, r"^[1-5](\.0+)?$"), 5)
    reject(pc.invert(pc.match_substring_regex(text, "[\\x{fffd}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]")), 6)
    late = (reason >= 4) & (offset < 0)
    offset[late] = 0
    good = pa.array(reason < 0)
    none = lambda a, kind: pc.if_else(good, a, pa.scalar(None, kind))
    code = pa.array(reason, mask=reason < 0)
    stars = pc.if_else(good, pc.utf8_slice_codeunits(score, 0, 1), pa.scalar(None, pa.string())).cast(pa.int32())
    return [pa.array(REASONS).take(code), pa.array(offset, mask=reason < 0), none(pid, pa.string()), none(num, pa.int32()), none(den, pa.int32()), stars, none(text, pa.string())]


SCHEMA = "rec_id bigint, reason string, error_offset bigint, product_id string, helpfulness_num int, helpfulness_den int, score int, text string"
ARROW = pa.schema([("rec_id", pa.int64()), ("reason", pa.string()), ("error_offset", pa.int64()), ("product_id", pa.string()), ("helpfulness_num", pa.int32()), ("helpfulness_den", pa.int32()), ("score", pa.int32()), ("text", pa.string())])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about GROUP_BYTES of records each; a longer record is a run of its own."""
    size = np.cumsum(np.asarray(pc.binary_length(batch.column(2)).fill_null(0)).astype(np.int64))
    cuts = np.flatnonzero(np.diff(size // GROUP_BYTES)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _pieces(whole):
            records = pa.concat_arrays([batch.column(2).cast(pa.string())])
            layout = np.where(np.asarray(pc.equal(batch.column(1), "line").fill_null(False)), 0, 1)
            out = [batch.column(0), *_typed(records, layout)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, ARROW, strict=True)], schema=ARROW)


def parse(raw: DataFrame) -> DataFrame:
    """One row per row of raw (rec_id, layout, record): typed values, or the reason and offset of its failure.

    A valid record has a null reason and error_offset; a rejected one has null values, the first reason that applies
    (REASONS) and the byte offset in the record at which it shows (its end, if something is missing there; the record's
    start for invalid values). A null, empty or blank record is ``empty``. A layout other than ``line``, null too, is
    read as a block. Repeated rows each come out; a null rec_id is kept; extra columns are ignored; an empty table gives
    an empty result.
    """
    return raw.select(F.col("rec_id").cast("bigint"), F.col("layout").cast("string"), F.col("record").cast("string")).mapInArrow(_run, SCHEMA)


def split(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid reviews as typed rows, rejected records with reason and offset)"""
    both = parse(raw)
    return both.where("reason IS NULL").drop("reason", "error_offset"), both.where("reason IS NOT NULL").select("rec_id", "reason", "error_offset")
