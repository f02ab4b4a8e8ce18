"""Vector codes by product quantisation: Lloyd's rounds with Elkan's bounds, in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.llm._common import forget_since, mark, materialise, ship, spread_join, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are held within this, so that they and their differences are 64-bit integers.
LIMIT = 1 << 62
MOST_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Codebook:
    """Integer entries (part, entry, position)."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def half_up(x: np.ndarray) -> np.ndarray:
    """Upper halves of 32-bit floats, as uint16, of numbers at least x (not negative): what upper bounds are kept in."""
    f = np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))
    return ((f.view(np.uint32).astype(np.uint64) + 0xFFFF) >> np.uint64(16)).astype(np.uint16)


def half_down(x: np.ndarray) -> np.ndarray:
    """The same of numbers at most x, 0 at least: what lower bounds are kept in."""
    f = np.nextafter(np.maximum(np.asarray(x, np.float64), 0).astype(np.float32), np.float32(-np.inf))
    return (np.maximum(f, np.float32(0)).view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def unhalf(h: np.ndarray) -> np.ndarray:
    return (h.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis: 64-bit integers, or Python's where those could overflow."""
    most = max((int(np.abs(x).max()) for x in (a, b) if x.size), default=0)
    if max(a.shape[-1], 1) * (2 * most) ** 2 >= MOST_LONG:
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(-1) if d.shape[-1] else np.zeros(d.shape[:-1], np.int64)


def root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(d2, dtype=np.float64))


def assign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries of new (ties: the least index) for vectors x (n, part, position), and their bounds.

    code, upper (n, part) and lower (n, part, entry) hold for the entries of old: they are shifted by how far each entry moved. An entry is left out only
    if a bound says that it is strictly farther than the present one; the distances of all others are computed in whole numbers.
    """
    n, parts, _ = x.shape
    code, upper, lower = code.copy(), upper.copy(), lower.copy()
    for j in range(parts):
        c = new[j]
        moved = unhalf(half_up(root(squared(old[j], c))))
        apart = unhalf(half_down(root(squared(c[:, None], c[None])) * (1 - 1e-12)))
        a = code[:, j].astype(np.int64)
        up = unhalf(half_up(unhalf(upper[:, j]) + moved[a]))
        low = unhalf(half_down(unhalf(lower[:, j]) - moved))
        near = lambda up, low, a: (low <= up[:, None]) & (apart[a] <= 2 * up[:, None])
        open_ = near(up, low, a)
        open_[np.arange(n), a] = False
        at = np.flatnonzero(open_.any(1))
        if len(at):
            own = squared(x[at, j], c[a[at]])  # the present entry's distance first: it may settle the rest
            up[at] = unhalf(half_up(root(own) * (1 + 1e-12)))
            low[at, a[at]] = unhalf(half_down(root(own) * (1 - 1e-12)))
            left = open_[at] & near(up[at], low[at], a[at])
            row, entry = np.nonzero(left)
            found = squared(x[at[row], j], c[entry])
            low[at[row], entry] = unhalf(half_down(root(found) * (1 - 1e-12)))
            wide = found.dtype == object or own.dtype == object
            d2 = np.full((len(at), len(c)), 1 << 140 if wide else MOST_LONG, object if wide else np.int64)
            d2[np.arange(len(at)), a[at]] = own
            d2[row, entry] = found
            best = d2.argmin(1) if not wide else np.array([min(range(len(c)), key=r.__getitem__) for r in d2], np.int64)
            code[at, j] = best
            up[at] = unhalf(half_up(root(d2[np.arange(len(at)), best]) * (1 + 1e-12)))
        upper[:, j], lower[:, j] = half_up(up), half_down(low)
    return code, upper, lower


def quantised(vectors: DataFrame, vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vec): integers floor(scale * component), little-endian, in 2, 4 or 8 bytes each as the vector needs (vec's first byte says how many).

    Rows whose vector is null or has components that are null, NaN or infinite go. Components beyond 2^62 / scale count as that.
    """
    ship(vectors.sparkSession)
    fine = F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(fine).select("vec_id", "label", F.col(vec).cast("array<double>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2)
            ends = np.asarray(col.offsets, dtype=np.int64)
            v = np.floor(np.asarray(col.values.to_numpy(zero_copy_only=False), np.float64) * scale)
            v = np.where(np.abs(v) >= LIMIT, np.sign(v) * float(LIMIT), v).astype(np.int64)
            out = []
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                own = v[lo:hi]
                size = next(s for s, kind in ((2, np.int16), (4, np.int32), (8, np.int64)) if not len(own) or (own.min() >= np.iinfo(kind).min and own.max() <= np.iinfo(kind).max))
                out.append(bytes([size]) + own.astype(f"<i{size}").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, vec binary")


def unpacked(vecs: list[bytes], parts: int, width: int) -> np.ndarray:
    """(n, part, position) integers; vectors shorter than the table's longest end in zeros."""
    out = np.zeros((len(vecs), parts * width), np.int64)
    sizes = {len(v) for v in vecs}
    if len(sizes) == 1 and len({v[:1] for v in vecs}) == 1:
        size = vecs[0][0]
        own = np.frombuffer(b"".join(v[1:] for v in vecs), f"<i{size}").reshape(len(vecs), -1)
        out[:, : own.shape[1]] = own
    else:
        for i, v in enumerate(vecs):
            own = np.frombuffer(v, f"<i{v[0]}", offset=1)
            out[i, : len(own)] = own
    return out.reshape(len(vecs), parts, width)


def _rounds(rows: DataFrame, old: Codebook, new: Codebook, errors: bool = False) -> DataFrame:
    """rows with code, upper and lower by the entries of new; errors: with code and error alone (a long, held at its end)."""
    parts, entries, width = new.entries.shape
    first = "code" not in rows.columns
    before, after = old.entries, new.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                b = whole.slice(begin, 4096)
                n = b.num_rows
                col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
                x = unpacked(col["vec"].to_pylist(), parts, width)
                read = lambda name, kind, shape: np.frombuffer(b"".join(col[name].to_pylist()), kind).reshape(shape)  # noqa: B023, E731
                if first:
                    code, upper, lower = np.zeros((n, parts), np.uint8), half_up(np.full((n, parts), np.inf)), np.zeros((n, parts, entries), np.uint16)
                else:
                    code, upper, lower = read("code", np.uint8, (n, parts)), read("upper", np.uint16, (n, parts)), read("lower", np.uint16, (n, parts, entries))
                code, upper, lower = assign(x, code, upper, lower, before, after)
                text = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                if errors:
                    d2 = squared(x, after[np.arange(parts)[None], code]).sum(1)
                    error = pa.array([min(int(e), MOST_LONG) for e in d2], pa.int64())
                    yield pa.RecordBatch.from_arrays([col["vec_id"], col["label"], pa.array([r.tobytes().hex() for r in code], pa.string()), error], names=["vec_id", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([col["vec_id"], col["label"], col["vec"], text(code), text(upper), text(lower)], names=["vec_id", "label", "vec", "code", "upper", "lower"])

    kinds = dict(rows.dtypes)
    own = f"vec_id {kinds['vec_id']}, label {kinds['label']}, "
    return rows.mapInArrow(run, own + ("code string, error long" if errors else "vec binary, code binary, upper binary, lower binary"))


def _means(rows: DataFrame, old: Codebook) -> Codebook:
    """Each entry replaced by floor(sum / count) of the parts that have it; one without parts stays. The driver gets the sums: a number for each component of the codebook."""
    parts, entries, width = old.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = unpacked(b.column(0).to_pylist(), parts, width)
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            wide = b.num_rows * int(np.abs(x).max(initial=0)) >= MOST_LONG
            for j in range(parts):
                own = np.zeros((entries, width), object if wide else np.int64)
                np.add.at(own, code[:, j], x[:, j].astype(object) if wide else x[:, j])
                sums[j] += own.astype(object)
                counts[j] += np.bincount(code[:, j], minlength=entries)
        p, e, i = (a.ravel() for a in np.indices((parts, entries, width + 1)))  # place `width` has the count
        value = np.concatenate([sums, counts[:, :, None].astype(object)], axis=2).ravel()
        keep = np.flatnonzero(np.repeat(counts.ravel() > 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(a[keep].astype(np.int32)) for a in (p, e, i)] + [pa.array([str(value[k]) for k in keep], pa.string())], names=["p", "e", "i", "value"])

    found = rows.select("vec", "code").mapInArrow(run, "p int, e int, i int, value string")
    found = found.groupBy("p", "e", "i").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    total = {(r["p"], r["e"], r["i"]): int(r["value"]) for r in found}
    out = old.entries.astype(object)
    for (p, e, i), s in total.items():
        if i < width:
            out[p, e, i] = s // total[p, e, width]
    return Codebook(out.astype(np.int64))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vec: str = "embedding") -> tuple[DataFrame, Codebook]:
    """(vec_id, label, code, error) of all kept vectors, and the final codebook; see quantised() for what is kept.

    vectors: (vec_id, label, vec), other columns don't matter. Vectors are cut into `parts` equal consecutive parts; those shorter than the longest, or than
    a multiple of parts, end in zeros. Codebooks start as the parts of the vectors with the least vec_ids (nulls last, of equal ids by their integers); with fewer vectors than
    entries there are as many entries as vectors. After each round the vectors are written with their codes and bounds: an upper bound a part and a
    lower one an entry, in two bytes each. Rounds after one that moves no entry would change nothing, and are left out.
    error: the squared distances to the vector's entries, summed over parts; beyond a long's end, that end. code: two hex digits a part.
    """
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    since = mark(vectors.sparkSession)
    rows = materialise(quantised(vectors, vec), "vectors")
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    longest = rows.agg(F.max(F.try_divide(F.octet_length("vec") - 1, F.conv(F.hex(F.substring("vec", 1, 1)), 16, 10).cast("int"))).alias("n")).first()["n"]
    width = -(-int(longest or 0) // parts)
    first = unpacked([bytes(r["vec"]) for r in start], parts, width) if start else np.zeros((0, parts, width), np.int64)
    old = new = Codebook(np.ascontiguousarray(first.transpose(1, 0, 2)))
    if start:
        for _ in range(rounds):
            rows = materialise(_rounds(rows, old, new), "bounds")
            forget_since(since, rows)
            old, new = new, _means(rows, new)
            if np.array_equal(old.entries, new.entries):
                break
    out = materialise(_rounds(rows, old, new, errors=True), "codes")
    forget_since(since, out)
    return out, new


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the error summed over equal labels (nulls are equal; held at a long's end). A hot label is summed before it is shuffled and joined over several tasks."""
    names = codes.columns
    rows = codes.withColumn("known label", F.col("label").isNotNull()).withColumn("label's text", F.coalesce(F.col("label").cast("string"), F.lit("")))
    keys = ["known label", "label's text"]
    sums = rows.groupBy(*keys).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return spread_join(rows, sums, keys, "vec_id").select(*names, "label_error")


def op12_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, book = train(table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(book.sha256).alias("codebooks_sha256"))
