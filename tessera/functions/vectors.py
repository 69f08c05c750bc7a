"""Vector arithmetic on ``ARRAY<DOUBLE>`` columns, and the text-to-vector models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TextModel = Callable[[Column], Column]

_CODEGEN_DIMS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos, kept in [0, 2]; a zero vector has cosine 0 to everything."""
    cos = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) - cos))


def l2_normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays zero."""
    # the one-element array binds v and its length once; a bare lambda would work out |v| per component
    bound = F.array(F.struct(v.alias("v"), norm(v).alias("n")))
    scaled = F.transform(
        bound, lambda b: F.transform(b["v"], lambda x: F.coalesce(F.try_divide(x, b["n"]), F.lit(0.0)))
    )
    return scaled[0]


def _add(terms: list[Column]) -> Column:
    acc = terms[0]
    for term in terms[1:]:
        acc = acc + term
    return acc


def weighted_mean(parts: Sequence[tuple[Column, float]], dim: int | None = None) -> Column:
    """Sum of weight * vector over the sum of weights; one part is returned as it is.

    With a known small ``dim`` the components are written out, which generated code handles best.
    """
    if not parts:
        raise ValueError("no embeddings to combine")
    if len(parts) == 1:
        return parts[0][0]
    total = F.lit(float(sum(w for _, w in parts)))
    if dim is not None and dim <= _CODEGEN_DIMS:
        return F.array(*[_add([v[i] * F.lit(float(w)) for v, w in parts]) / total for i in range(dim)])
    return F.transform(weighted_sum(parts), lambda x: x / total)


def divided(vec: Column, n: float, dim: int) -> Column:
    """Vector over number; small vectors are written out by component."""
    if dim <= _CODEGEN_DIMS:
        return F.array(*[vec[i] / F.lit(float(n)) for i in range(dim)])
    return F.transform(vec, lambda x: x / F.lit(float(n)))


def weighted_sum(parts: Sequence[tuple[Column, float]], dim: int | None = None) -> Column:
    """Sum of weight * vector."""
    if dim is not None and dim <= _CODEGEN_DIMS:
        return F.array(*[_add([v[i] * F.lit(float(w)) for v, w in parts]) for i in range(dim)])

    def scale(vec: Column, weight: float) -> Column:
        return F.transform(vec, lambda x: x * F.lit(weight))

    acc = scale(parts[0][0], float(parts[0][1]))
    for vec, weight in parts[1:]:
        acc = F.zip_with(acc, scale(vec, float(weight)), lambda x, y: x + y)
    return acc


#: Digits that can be added up in a byte, and texts up to which a sum is written out (others are added in a lambda, which is
#: not compiled but has no limit).
_BYTE_DIGITS, _WRITTEN_OUT = 17, 64
_EVERY_OTHER = 0x0F0F0F0F


@dataclass(frozen=True)
class HashedText:
    """See :func:`hashed_text`."""

    dim: int

    def _eights(self, text: Column) -> list[Column]:
        """Eight digits each, read as one number, which all their components share."""
        digest = F.md5(text)
        return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(-(-self.dim // 8))]

    def __call__(self, text: Column) -> Column:
        eights = self._eights(text)
        digits = [F.shiftright(eights[i // 8], 28 - 4 * (i % 8)).bitwiseAND(15) for i in range(self.dim)]
        return F.array(*[F.lit(2.0) * d - F.lit(15.0) for d in digits])

    def total(self, texts: Sequence[Column]) -> Column:
        """Sum of the vectors of several texts, without a vector of each: every other digit of a number has a byte for itself,
        so numbers are added as they are."""
        if len(texts) > _WRITTEN_OUT:
            zero = F.array(*[F.lit(0.0)] * self.dim)
            return F.aggregate(F.transform(F.array(*texts), self), zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
        eights = [self._eights(t) for t in texts]

        def digits(i: int) -> Column:
            k, place = i // 8, 7 - i % 8
            sums = []
            for start in range(0, len(texts), _BYTE_DIGITS):
                own = [e[k] if place % 2 == 0 else F.shiftright(e[k], 4) for e in eights[start:start + _BYTE_DIGITS]]
                sums.append(F.shiftright(_add([x.bitwiseAND(_EVERY_OTHER) for x in own]), 8 * (place // 2)).bitwiseAND(255))
            return _add(sums)

        return F.array(*[F.lit(2.0) * digits(i) - F.lit(15.0 * len(texts)) for i in range(self.dim)])


def hashed_text(dim: int = 16) -> TextModel:
    """A deterministic model: component i is an odd integer in -15..15 taken from the i-th hex digit of the text's MD5."""
    if not 1 <= dim <= 32:
        raise ValueError("an MD5 digest gives 1 to 32 components")
    return HashedText(dim)


def zero_vector(dim: int = 10) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def mean_vector(df: DataFrame, keys: Sequence[str], vec: str, dim: int, out: str = "vec", count: str | None = None) -> DataFrame:
    """Element-wise mean per key with map-side partial sums, and the number of vectors as column ``count`` if named.

    Small vectors use one generated ``avg`` per component; long ones the ML summarizer.
    """
    counted = [F.count(F.lit(1)).alias(count)] if count else []
    kept = [*keys, count] if count else keys
    if dim <= _CODEGEN_DIMS:
        sums = [F.avg(F.col(vec)[i]).alias(f"_m{i}") for i in range(dim)]
        pooled = df.groupBy(*keys).agg(*sums, *counted)
        return pooled.select(*kept, F.array(*[F.col(f"_m{i}") for i in range(dim)]).alias(out))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    pooled = df.groupBy(*keys).agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("_mean"), *counted)
    return pooled.select(*kept, vector_to_array("_mean").alias(out))


def vector_columns(vec: str, dim: int, prefix: str = "v", digits: int | None = 6) -> list[Column]:
    """One scalar column per component, for reports and comparisons."""
    return [(F.round(F.col(vec)[i], digits) if digits is not None else F.col(vec)[i]).alias(f"{prefix}{i}") for i in range(dim)]
