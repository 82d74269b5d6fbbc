"""Fill-in-middle transformation (13): displacement scatter.

A text is cut into units (``[A-Za-z]+`` or one other code point) and split at two
hashed cuts into prefix, middle and suffix. A batch of texts is one byte buffer: a
scan finds the byte places of the cuts; a difference array holds, at the start of
each part, by how much its shift differs from that of the part before, and its
running sum is every byte's shift into the output buffer, where one scatter puts
them all. The marks go into the places left free. Restoring reads output and form
only: the marks found in an output give the parts, a difference array their shifts,
and one gather brings the bytes back.

The form is ``plain`` (the text as it is) if the text is empty, holds a mark, or is
dealt so by hash; else ``spm`` (suffix first) or ``psm`` (prefix first).

Null text is an empty text, so it is plain and comes back empty. A null doc_id is
hashed as no digits; rows that share a doc_id are cut by the same hash, each by its
own length. An empty table gives an empty result. Texts of any length are
transformed whole; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import arrow_schema, id_and_text, read_table, slices

# The marks, and how many of a hundred documents stay plain or have the suffix first.
MARKS = (b"<P>", b"<S>", b"<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = "1"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Which part stands behind which mark, in the output's order (0 prefix, 1 middle, 2 suffix; marks by the same numbers).
ORDER = {PSM: (0, 2, 1), SPM: (2, 0, 1)}
MARK_OF = {0: MARKS[0], 2: MARKS[1], 1: MARKS[2]}
MARK = len(MARKS[0])
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
BACK = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"


def hashes(ids: list, seed: str) -> np.ndarray:
    """The first four 32-bit groups of each id's SHA-256."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: none) and the bounds of its rows."""
    raw = [(t or "").encode() for t in column.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([raw[a:b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.string())


def marks_in(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of marks in a buffer of texts, which of ``MARKS`` each is, and the text that holds it whole."""
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">"))) if len(data) > 2 else np.zeros(0, np.int64)
    kind = np.full(len(at), -1)
    for i, mark in enumerate(MARKS):
        kind[data[at + 1] == mark[1]] = i
    owner = np.searchsorted(bounds, at, side="right") - 1
    whole = (kind >= 0) & (at + MARK <= bounds[owner + 1])
    return at[whole], kind[whole], owner[whole]


def running(n: int, at: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The running sum of a difference array of ``n`` places that has ``steps`` at ``at``."""
    differences = np.zeros(n + 1, np.int64)
    np.add.at(differences, at, steps)
    return np.cumsum(differences)[:n]


def shifts(n: int, starts: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Per place of a buffer its shift, when the part at ``starts`` (ascending) moves to ``targets``."""
    shift = targets - starts
    return running(n, starts, np.diff(shift, prepend=0))


class Units:
    """Where the units and code points of a buffer of texts begin."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.code_point = (data & 0xC0) != 0x80
        lower = data | 0x20
        letter = (lower >= ord("a")) & (lower <= ord("z")) & (data < 0x80)
        inside = np.concatenate([[False], letter[1:] & letter[:-1]]) if len(data) else letter
        inside[bounds[:-1][bounds[:-1] < len(data)]] = False  # a text's first letter begins a unit
        self.start = np.flatnonzero(self.code_point & ~inside)
        self.first = np.searchsorted(self.start, bounds)
        self.n = np.diff(self.first)
        self.bounds = bounds
        self.chars_before = np.concatenate([[0], np.cumsum(self.code_point, dtype=np.int64)])

    def byte_of(self, unit: np.ndarray) -> np.ndarray:
        """The byte place behind the first ``unit`` units of each text."""
        at = np.append(self.start, self.bounds[-1])
        return np.where(unit < self.n, at[self.first[:-1] + np.minimum(unit, self.n)], self.bounds[1:])


def scatter(data: np.ndarray, bounds: np.ndarray, cut1: np.ndarray, cut2: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The output buffer and its bounds."""
    moved = form != PLAIN
    out_bounds = np.concatenate([[0], np.cumsum(np.diff(bounds) + 3 * MARK * moved)])
    edges = np.stack([bounds[:-1], cut1, cut2, bounds[1:]])  # prefix, middle and suffix begin here
    size = np.diff(edges, axis=0)
    target = np.stack([edges[0], edges[1], edges[2]]) - bounds[:-1] + out_bounds[:-1]
    out = np.zeros(out_bounds[-1], np.uint8)
    for name, order in ORDER.items():
        mine = np.flatnonzero(form == name)
        place = out_bounds[:-1][mine]
        for part in order:
            for j in range(MARK):
                out[place + j] = MARK_OF[part][j]
            target[part, mine] = place + MARK
            place = place + MARK + size[part, mine]
    shift = shifts(len(data), edges[:3].T.ravel(), target.T.ravel())
    out[np.arange(len(data)) + shift] = data
    return out, out_bounds


def gather(data: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' buffer and bounds, from outputs and forms alone."""
    moved = np.flatnonzero(form != PLAIN)
    text_bounds = np.concatenate([[0], np.cumsum(np.diff(bounds) - 3 * MARK * (form != PLAIN))])
    at, kind, owner = marks_in(data, bounds)
    real = (form[owner] != PLAIN) if len(at) else np.zeros(0, bool)
    at, kind, owner = at[real], kind[real], owner[real]
    whole = (form == PLAIN) & (np.diff(bounds) > 0)
    starts, sources = [text_bounds[:-1][whole]], [bounds[:-1][whole]]
    if len(moved):
        if len(at) != 3 * len(moved) or (owner != np.repeat(moved, 3)).any():
            raise ValueError("an output does not hold its three marks")
        at = at.reshape(-1, 3)
        end = np.concatenate([at[:, 1:], bounds[1:][moved][:, None]], axis=1)  # each part ends at the next mark
        part = np.array([0, 2, 1])[kind.reshape(-1, 3)]
        order = np.argsort(part, axis=1)
        begin, size = (np.take_along_axis(x, order, 1) for x in (at + MARK, end - at - MARK))
        real = size > 0  # an empty part would begin where the next text does
        starts.append((text_bounds[:-1][moved][:, None] + np.cumsum(size, 1) - size)[real])
        sources.append(begin[real])
    starts, sources = np.concatenate(starts), np.concatenate(sources)
    order = np.argsort(starts, kind="stable")
    n = int(text_bounds[-1])
    return data[np.arange(n) + shifts(n, starts[order], sources[order])], text_bounds


def transformed(docs: DataFrame, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, its units ``n``, ``form``, the code points of prefix and middle (null if plain), and ``output``."""
    schema = arrow_schema(OUT)

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_pylist()
                data, bounds = buffer_of(part.column("text"))
                units, h = Units(data, bounds), hashes(ids, seed)
                a, b = h[:, 0] % (units.n + 1), h[:, 1] % (units.n + 1)
                cut1, cut2 = units.byte_of(np.minimum(a, b)), units.byte_of(np.maximum(a, b))
                marked = np.zeros(len(ids), bool)
                marked[marks_in(data, bounds)[2]] = True
                plain = (np.diff(bounds) == 0) | marked | (h[:, 2] % 100 >= plain_from)
                form = np.where(plain, PLAIN, np.where(h[:, 3] % 100 < spm_below, SPM, PSM))
                out, out_bounds = scatter(data, bounds, cut1, cut2, form)
                chars = units.chars_before
                columns = (pa.array(ids, pa.int64()), pa.array(units.n, pa.int64()), pa.array(form.tolist(), pa.string()),
                           pa.array(chars[cut1] - chars[bounds[:-1]], pa.int64(), mask=plain),
                           pa.array(chars[cut2] - chars[cut1], pa.int64(), mask=plain), strings(out, out_bounds))
                yield pa.RecordBatch.from_arrays(list(columns), schema=schema)

    return id_and_text(docs).mapInArrow(cut, OUT)


def restored(outputs: DataFrame) -> DataFrame:
    """``transformed``'s rows with ``restored``, the text rebuilt from ``output`` and ``form``."""
    schema = arrow_schema(BACK)

    def rebuild(batches):
        for batch in batches:
            for part in slices(batch, "output"):
                data, bounds = buffer_of(part.column("output"))
                text, text_bounds = gather(data, bounds, np.array(part.column("form").to_pylist(), object))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in list(schema)[:-1]), strings(text, text_bounds)], schema=schema)

    return outputs.mapInArrow(rebuild, BACK)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restored(transformed(read_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLE = {"op13_fill_in_middle": r"""
WITH unit AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
hashed AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM unit),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
part AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                   ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM part
"""}
