"""Vocabulary and term weights as a stage of an ML pipeline, with parameters that are saved."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
    MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftloom.operators.vocabulary import bag_of_words, counts_in_documents, document_terms, select_vocabulary, term_counts, tfidf

SCHEMA = "term_id int, term string, n bigint, df bigint, idf double"


class _TermParams(HasInputCol, HasOutputCol):
    idCol = Param(Params._dummy(), "idCol", "column that tells documents apart", TypeConverters.toString)
    maxNgram = Param(Params._dummy(), "maxNgram", "words of the longest term", TypeConverters.toInt)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "terms of the vocabulary, 0 for all", TypeConverters.toInt)
    minDf = Param(Params._dummy(), "minDf", "documents a term stands in at least", TypeConverters.toInt)
    weighting = Param(Params._dummy(), "weighting", "counts or tfidf", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(
            inputCol="text", outputCol="features", idCol="doc_id", maxNgram=2, maxFeatures=0, minDf=1, weighting="tfidf"
        )

    def _counts(self, docs: DataFrame) -> DataFrame:
        """(doc_id, term, n) of documents under any column names."""
        taken = docs.select(
            F.col(self.getOrDefault(self.idCol)).alias("doc_id"), F.coalesce(self.getInputCol(), F.lit("")).alias("text")
        )
        return counts_in_documents(document_terms(taken, max_len=1), max_len=self.getOrDefault(self.maxNgram))


class TermVectoriser(Estimator, _TermParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the vocabulary of a text column.

    `weighting` is "counts" or "tfidf". The vocabulary stays a table: it may have
    more terms than one machine holds.
    """

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="features", idCol="doc_id", maxNgram=2, maxFeatures=0, minDf=1, weighting="tfidf"):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TermModel:
        if self.getOrDefault(self.weighting) not in ("counts", "tfidf"):
            raise ValueError(f"weighting is counts or tfidf, not {self.getOrDefault(self.weighting)!r}")
        n_docs, most = dataset.count(), self.getOrDefault(self.maxFeatures)
        stats = term_counts(self._counts(dataset))
        vocabulary = select_vocabulary(stats, n_docs, most or None, self.getOrDefault(self.minDf))
        return self._copyValues(TermModel(vocabulary))


class TermModel(Model, _TermParams, MLReadable, MLWritable):
    """Adds `outputCol`, the known terms of each document as array<struct<term_id, x>> in order of term_id.

    A document without known terms, a null text among them, has an empty array.
    """

    def __init__(self, vocabulary: DataFrame | None = None):
        super().__init__()
        self._defaults()
        self.vocabulary = vocabulary

    def _transform(self, dataset: DataFrame) -> DataFrame:
        counts, key, out = self._counts(dataset), self.getOrDefault(self.idCol), self.getOutputCol()
        if self.getOrDefault(self.weighting) == "tfidf":
            weights = tfidf(counts, self.vocabulary)
        else:
            weights = bag_of_words(counts, self.vocabulary).select("doc_id", "term_id", F.col("n").cast("double").alias("x"))
        rows = weights.groupBy(F.col("doc_id").alias("_id")).agg(
            F.array_sort(F.collect_list(F.struct("term_id", "x"))).alias("_found")
        )
        joined = dataset.join(rows, F.col(key).eqNullSafe(F.col("_id")), "left")
        none = F.array().cast("array<struct<term_id:int,x:double>>")
        return joined.withColumn(out, F.coalesce("_found", none)).drop("_id", "_found")

    def write(self) -> MLWriter:
        return _TermModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TermModelReader()


class _TermModelWriter(MLWriter):
    def __init__(self, model: TermModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.vocabulary.write.parquet(f"{path}/vocabulary")


class _TermModelReader(MLReader):
    def load(self, path: str) -> TermModel:
        spark: SparkSession = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = TermModel(spark.read.schema(SCHEMA).parquet(f"{path}/vocabulary"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
