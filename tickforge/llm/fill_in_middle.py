"""Fill-in-middle transformation by displacement scatter.

The texts of an Arrow batch lie one after the other in one byte buffer. Two cuts part each text into prefix, middle
and suffix, and every byte of a part moves by the same distance, so a difference array with one entry per part
start, summed up, is each byte's displacement. One scatter writes all outputs of the batch; reading them back is the
inverse gather with the displacements that the markers in the output give. Nothing is shuffled: a row depends on its
id and text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.llm.common import fields, spare

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
MARKERS = b"<P>", b"<S>", b"<M>"  # prefix, suffix, middle; a text that holds one stays plain
WIDTH = 3
FORMS = np.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = range(3)
SLICE_BYTES = 2_000_000  # bytes of text moved at once; a longer text is a slice of its own

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: UTF-8 and so also the white space of a unit and the markers can be looked at byte by byte.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each text in them; null counts as empty."""
    flat = column.cast(pa.large_binary())
    if flat.null_count:
        flat = flat.fill_null(b"")
    offsets = np.frombuffer(flat.buffers()[1], "i8")[flat.offset:flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", "u1")[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("i4")
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of about ``SLICE_BYTES`` of text, a row at least."""
    _, offsets = _bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each unit ends, how many units lie before each text, and how many each text has.

    A unit is a word with the white space before it; white space after the last word is one more.
    """
    space, last = IS_SPACE[data], offsets[1:][np.diff(offsets) > 0] - 1
    ends = ~space
    ends[:-1] &= space[1:]
    ends[last] = True
    counted = np.concatenate([[0], np.cumsum(ends)])
    return np.flatnonzero(ends) + 1, counted[offsets[:-1]], np.diff(counted[offsets])


def _markers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in the text and second byte of every marker, in order."""
    if len(data) < WIDTH:
        none = np.empty(0, "i8")
        return none, none, none.astype("u1")
    second = data[1:-1]
    at = np.flatnonzero((data[:-2] == MARKERS[0][0]) & (data[2:] == MARKERS[0][2]) & np.isin(second, [m[1] for m in MARKERS]))
    text = np.searchsorted(offsets, at, "right") - 1
    inside = at + WIDTH <= offsets[text + 1]
    at, text = at[inside], text[inside]
    return text, at - offsets[text], second[at]


def _displacements(offsets: np.ndarray, moved: np.ndarray, form: np.ndarray, prefix: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """How far every byte of the texts at ``offsets`` lies from its place in outputs that begin at ``moved``."""
    begin, base = offsets[:-1], moved - offsets[:-1]
    suffix = np.diff(offsets) - prefix - middle
    shift = np.stack([base + np.choose(form, [0, WIDTH, 2 * WIDTH + suffix]),
                      base + np.where(form == PLAIN, 0, 3 * WIDTH + suffix),
                      base + np.choose(form, [0, 2 * WIDTH - middle, WIDTH - prefix - middle])], axis=1).ravel()
    change = np.zeros(offsets[-1] + 1, "i8")
    np.add.at(change, np.stack([begin, begin + prefix, begin + prefix + middle], axis=1).ravel(), np.diff(shift, prepend=0))
    return np.cumsum(change)[:-1]


def _scattered(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, prefix: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of the outputs."""
    sizes = np.diff(offsets) + np.where(form == PLAIN, 0, 3 * WIDTH)
    moved = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), "u1")
    out[np.arange(len(data)) + _displacements(offsets, moved, form, prefix, middle)] = data
    suffix = np.diff(offsets) - prefix - middle
    places = {PSM: (0 * prefix, WIDTH + prefix, 2 * WIDTH + prefix + suffix), SPM: (WIDTH + suffix, 0 * suffix, 2 * WIDTH + suffix + prefix)}
    for f, at in places.items():
        rows = form == f
        for marker, place in zip(MARKERS, at, strict=True):
            for i, byte in enumerate(marker):
                out[moved[rows] + place[rows] + i] = byte
    return out, sizes


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT) -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars, output for every row, from whole texts.

    The sha256 of ``seed:id`` gives four numbers: two cuts, the draw against ``fim_percent`` and the one against
    ``spm_percent``. Null and empty texts, and texts that hold a marker, are plain: their output is the text (empty for
    null) and their lengths are null. A null id draws as an empty one. Repeated rows give equal rows, rows that share an
    id share the draws; other columns are not read and an empty table gives an empty table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                data, offsets = _bytes(batch.column(1))
                h1, h2, h3, h4 = (batch.column(2 + i).to_numpy() for i in range(4))
                ends, before, n = _units(data, offsets)
                held = np.zeros(len(n), bool)
                held[_markers(data, offsets)[0]] = True
                form = np.where((n == 0) | held | (h3 % 100 >= fim_percent), PLAIN, np.where(h4 % 100 < spm_percent, SPM, PSM))
                ends = np.append(ends, 0)
                first, second = (np.where(k > 0, ends[before + k - 1], offsets[:-1]) for k in (
                    np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))))
                out, sizes = _scattered(data, offsets, form, first - offsets[:-1], second - first)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n), pa.array(FORMS[form]), pa.array(points[first] - points[offsets[:-1]], mask=form == PLAIN),
                     pa.array(points[second] - points[first], mask=form == PLAIN), _strings(out, sizes)],
                    names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]
    schema = T.StructType([*fields(docs, id_col), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                           T.StructField("output", T.StringType())])
    return docs.select(id_col, text_col, *draws).mapInArrow(run, schema)


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``rows`` with ``restored``, the text that each output was made from, read from the output and its form alone.

    A null output counts as an empty one. An output whose markers do not fit its form is an error.
    """
    known, name = rows.columns, spare(rows, "restored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, known.index(output_col)):
                data, offsets = _bytes(batch.column(known.index(output_col)))
                names = np.array(batch.column(known.index(form_col)).to_pylist(), "O")
                form = np.select([names == FORMS[PSM], names == FORMS[SPM]], [PSM, SPM], PLAIN)
                text, place, kind = _markers(data, offsets)
                mine = form[text] != PLAIN
                cut = np.flatnonzero(form != PLAIN)
                text, place, kind = text[mine], place[mine], kind[mine]
                order = np.array([[0] * 3, [m[1] for m in MARKERS], [m[1] for m in (MARKERS[1], MARKERS[0], MARKERS[2])]], "u1")
                if not np.array_equal(text, np.repeat(cut, 3)) or not np.array_equal(kind, order[form[cut]].ravel()):
                    raise ValueError("an output does not hold the markers of its form")
                a, b, c = place.reshape(-1, 3).T
                size = np.diff(offsets)
                one, two, three = b - a - WIDTH, c - b - WIDTH, size[cut] - c - WIDTH
                if a.any():
                    raise ValueError("an output does not begin with a marker")
                prefix, middle = np.zeros(len(size), "i8"), np.zeros(len(size), "i8")
                prefix[cut], middle[cut] = np.where(form[cut] == PSM, one, two), three
                sizes = size - np.where(form == PLAIN, 0, 3 * WIDTH)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                at = np.arange(ends[-1]) + _displacements(ends, offsets[:-1], form, prefix, middle)
                yield pa.RecordBatch.from_arrays([*batch.columns, _strings(data[at], sizes)], names=[*known, name])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u,
             sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
  d AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM t),
  c AS (SELECT doc_id, text, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= {FIM_PERCENT}
               THEN 'plain' WHEN h[4] % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM d),
  p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
          array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
