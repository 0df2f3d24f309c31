"""Vector expressions and the default text embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 384

Embedder = Callable[[DataFrame, str, str], DataFrame]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    # The one-element array binds the norm once; inside the lambda it would run per entry.
    scaled = F.transform(
        F.array(norm(v)),
        lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))),
    )
    return F.get(scaled, F.lit(0))


def fit_dim(v: Column, dim: int = DIM) -> Column:
    """Cut to ``dim`` entries, or padded with zeros."""
    padding = F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(v), F.lit(0)))
    return F.concat(F.slice(v.cast("array<double>"), 1, dim), padding)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when one side is a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def match_percent(similarity: Column) -> Column:
    return F.round(similarity * 100, 2)


def tokens(text: Column) -> Column:
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.filter(words, lambda w: w != "")


def token_buckets(text: Column, dim: int = DIM) -> Column:
    """One bucket number per word of the text, from the first 32 bits of its md5."""
    return F.transform(
        tokens(text),
        lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dim,
    )


def embed_hashed(df: DataFrame, text: str, out: str, dim: int = DIM) -> DataFrame:
    """Default embedding: unit-length counts of hashed words.

    Row-local and JVM-side: a count model over the fixed ``dim`` bucket names turns
    the words into counts, so no exploded word is shuffled.
    """
    bucket, counts, unit = f"_{out}_bucket", f"_{out}_counts", f"_{out}_unit"
    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], inputCol=bucket, outputCol=counts)
    buckets = token_buckets(F.coalesce(F.col(text), F.lit("")), dim).cast("array<string>")
    counted = model.transform(df.withColumn(bucket, buckets))
    scaled = Normalizer(p=2.0, inputCol=counts, outputCol=unit).transform(counted)
    return scaled.withColumn(out, vector_to_array(unit, "float32")).drop(bucket, counts, unit)
