"""Vector code compression: product codes from integer codebooks.

A component x becomes the integer floor(1024 x); a vector is cut into ``PARTS``
equal parts, and each part is replaced by the number of the nearest entry of its
position's codebook.  Codebooks start as the parts of the smallest ids and move
to their parts' mean (rounded down) in ``ROUNDS`` rounds, all in integers, so
the result does not depend on partitions, order or machine.

The nearest entry is found by float32 matrix products that screen and integers
that decide: the product gives each entry's squared distance (less the part's
own square) with an interval from the bounds of rounding errors of a dot product
in any order of summation.  Entries whose interval overlaps the lowest upper end
are re-evaluated in int64, and ties go to the lower index.

A round is one pass: every task sums its parts by entry, and the sums (a row an
entry and task) are added up by Spark.  A codebook's size is fixed by parameters
(entries x length of a vector), so it travels to the tasks in their closure.

Defined results: vectors that are null, or hold null or non-finite components
(also once multiplied), take no part, nor do those of another length than most
(of equally frequent lengths the smaller counts); a length that the parts do not
divide is filled up with zeros; integers beyond +-2**30 / sqrt(length) stop there
(for 64 components: +-131,072 of the original numbers), so that sums of squares
fit 64 bits.  Repeated rows all count; of rows with one vec_id the smaller
vector comes first into the codebook; null vec_ids come last.  With fewer rows
than entries a codebook has an entry a row; an empty table gives an empty
result; other columns stay, and where the rows have a column code or error
already, the new one's name gets a trailing underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from paceline.llm.common import checkpointed, fresh_name, joined, small, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Unit roundoff of float32.
UNIT = 2.0**-24
#: Rows that one matrix product screens.
BLOCK = 2048


def usable(rows: DataFrame) -> DataFrame:
    """The rows that take part, their embedding as doubles."""
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf"))))
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (size[0]["d"] if size else -1))


def integers(column: pa.Array, parts: int) -> np.ndarray:
    """int64 [rows, parts, width] of vectors."""
    n = len(column)
    x = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).reshape(n, -1) if n else np.empty((0, 0))
    limit = float(int(2**30 / max(1, x.shape[1]) ** 0.5))
    x = np.clip(x, -limit, limit).astype(np.int64)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
    return x.reshape(n, parts, x.shape[1] // parts)


def screened(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) of all pairs whose interval overlaps the row's lowest upper end.

    With y and c the float32 forms of a part and an entry (each off by UNIT at
    most, relatively), the computed score |c|**2 - 2 y c is off by no more than
    g (|c|**2 + 2 |x| |c|), g = (m + 8) UNIT / (1 - (m + 8) UNIT), for any order
    of summation: m products and sums, two conversions, the square's own
    conversion, the doubling (exact) and the last subtraction.
    """
    m = book.shape[1] + 8
    g = m * UNIT / (1 - m * UNIT)
    squares = (book * book).sum(1).astype(np.float64)
    score = squares.astype(np.float32) - np.float32(2) * (x.astype(np.float32) @ book.astype(np.float32).T)
    own = np.sqrt((x * x).sum(1).astype(np.float64))
    error = 1.01 * g * (squares + 2 * own[:, None] * np.sqrt(squares))  # 1.01: for the doubles of this line
    low = score - error
    return np.nonzero(low <= (score + error).min(1, keepdims=True))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry (lowest index of ties) and its squared distance, exact."""
    rows, entries = screened(x, book)
    off = x[rows] - book[entries]
    exact = (off * off).sum(1)
    order = np.lexsort((entries, exact, rows))
    rows, entries, exact = rows[order], entries[order], exact[order]
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    return entries[first], exact[first]


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes and squared distances, int64 [rows, parts]."""
    codes, errors = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
    for p, book in enumerate(books):
        for at in range(0, len(x), BLOCK):
            codes[at : at + BLOCK, p], errors[at : at + BLOCK, p] = nearest(x[at : at + BLOCK, p], book)
    return codes, errors


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """int64 [parts, entries, width]: the parts of the smallest vec_ids."""
    head = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries)
    x = integers(head.toArrow().column("embedding").combine_chunks(), parts)  # so many rows at most
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: entries at the floor of their parts' mean, unused ones as they were."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for batch in small(batches, BLOCK):
            x = integers(batch.column(0), parts)
            codes, _ = assigned(x, books)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    partial = rows.select("embedding").mapInArrow(run, "part bigint, entry bigint, n bigint, sums array<bigint>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    books = books.copy()
    for row in total.toLocalIterator():  # parts x entries rows at most
        books[row["part"], row["entry"]] = np.array(row["sums"], np.int64).reshape(-1) // row["n"]
    return books


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks int64 [parts, entries, width] of usable rows."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = moved(rows, books)
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """usable rows with code (two hex digits a part; more where a codebook has over 256 entries) and error."""
    names = [fresh_name(rows, "code"), fresh_name(rows, "error")]
    digits = max(2, len(f"{max(0, books.shape[1] - 1):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, BLOCK):
            if batch.num_rows:
                codes, errors = assigned(integers(batch.column(batch.schema.get_field_index("embedding")), len(books)), books)
                text = ["".join([f"{k:0{digits}x}" for k in row]) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(errors.sum(1), pa.int64())], [*batch.schema.names, *names])

    kind = StructType([*rows.schema.fields, StructField(names[0], StringType()), StructField(names[1], LongType())])
    return rows.mapInArrow(run, kind)


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The approximation that a code stands for, in the vectors' own numbers."""
    digits = max(2, len(f"{max(0, books.shape[1] - 1):x}"))
    picks = [int(code[i : i + digits], 16) for i in range(0, len(code), digits)]
    return np.concatenate([books[p, k] for p, k in enumerate(picks)]) / SCALE


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components, in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_errors(coded: DataFrame) -> DataFrame:
    """coded (label, error) with label_error, the error of all rows of the label."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return joined(coded, sums, "label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")))
    books = fit(rows)
    coded = checkpointed(encoded(rows, books).select("vec_id", "label", "code", "error"))
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds one by one, on vectors whose length the parts divide."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT k, part, arg_min(x, d) AS x, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT k, p.part, x, e, (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT AS d FROM p JOIN b{r} b ON p.part = b.part)
  GROUP BY k, part
)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (
  SELECT part, e, list(v ORDER BY i) AS c
  FROM (SELECT part, e, i, floor(sum(v) / count(*)) AS v FROM (SELECT part, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{r}) GROUP BY ALL)
  GROUP BY part, e
), b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.e = m.e)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT k, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) t(part)
), b0 AS MATERIALIZED (SELECT part, k - 1 AS e, x AS c FROM p WHERE k <= {ENTRIES}),
{", ".join(steps)},
s AS (SELECT k, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY k),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN s USING (k), h
"""


ORACLE = _oracle()
