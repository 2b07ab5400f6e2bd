"""Model-input preparation: imputation, scaling, category encoding, assembly.

Statistics are fitted once per training set in a bounded number of jobs
(medians for all columns in one job, mean/std for all columns in one job,
category vocabularies as one distributed table), then applied as column
expressions and joins with the vocabulary. The fitted model is a Spark ML stage
that a ``PipelineModel`` saves and loads.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml import Model
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.categories import clean_category
from .saved import SavedState
from .stats import column_medians, column_modes, fit_scaler
from .vocabulary import UNKNOWN_CODE, Vocabulary


def ordinal_encode(df: DataFrame, cols, suffix: str = "__ord", strip_quotes: bool = False,
                   null_token: str = "nan") -> tuple[DataFrame, Vocabulary]:
    """Lexicographic rank of each category string, unseen -> -1 (M4).

    Returns ``(encoded_df, vocabulary)``; the vocabulary can be reapplied to new
    data (unseen values get -1). NULLs are the string ``nan``, as with the
    reference's string conversion.
    """
    cleaned = df.withColumns({c: clean_category(c, strip_quotes, null_token) for c in cols})
    vocabulary = Vocabulary.fit(cleaned, cols)
    return apply_ordinal(cleaned, vocabulary, cols, suffix), vocabulary


def apply_ordinal(cleaned: DataFrame, vocabulary: Vocabulary, cols, suffix: str = "__ord") -> DataFrame:
    return vocabulary.encode(cleaned, cols, suffix, UNKNOWN_CODE)


@dataclass
class Preprocess:
    """Preprocessing spec: ``numeric`` in {'scale', 'zero+scale', 'median+scale'},
    ``categorical`` in {'ordinal', 'onehot'}."""

    numeric_cols: list
    categorical_cols: list
    numeric: str = "scale"
    categorical: str = "ordinal"
    strip_quotes: bool = False
    null_token: str = "nan"
    output: str = "features"

    def fit(self, df: DataFrame) -> "PreprocessModel":
        num_fill = {}
        if self.numeric == "zero+scale":
            num_fill = {c: 0.0 for c in self.numeric_cols}
        elif self.numeric == "median+scale":
            num_fill = {c: (0.0 if m is None else m)
                        for c, m in column_medians(df, self.numeric_cols).items()}
        filled = df.select(*[self._num_expr(c, num_fill, None).alias(c) for c in self.numeric_cols])
        scale = fit_scaler(filled, self.numeric_cols)
        cat = df.select(*[clean_category(c, self.strip_quotes, self.null_token).alias(c)
                          for c in self.categorical_cols])
        cat_fill = {}
        if self.categorical == "onehot" and self.categorical_cols:
            cat_fill = column_modes(cat, self.categorical_cols)
        vocabulary = encoder = None
        if self.categorical_cols:
            cat = cat.withColumns({c: F.coalesce(F.col(c), F.lit(cat_fill.get(c)))
                                   for c in self.categorical_cols if cat_fill.get(c) is not None})
            vocabulary = Vocabulary.fit(cat, self.categorical_cols)
            if self.categorical == "onehot":
                encoder = self._encoder(df.sparkSession, vocabulary.sizes)
        return PreprocessModel(self, num_fill, scale, cat_fill, vocabulary, encoder)

    def _encoder(self, spark, sizes: dict):
        """One-hot vectors as wide as each vocabulary.

        The encoder sees the largest code of each column; every code beyond it is "invalid", the last
        category, which dropLast removes: unseen values are all zeros.
        """
        cols = self.categorical_cols
        largest = spark.createDataFrame([tuple(float(max(sizes[c], 1) - 1) for c in cols)],
                                        ", ".join(f"`{c}__idx` double" for c in cols))
        return OneHotEncoder(inputCols=[c + "__idx" for c in cols], outputCols=[c + "__oh" for c in cols],
                             dropLast=True, handleInvalid="keep").fit(largest)

    @staticmethod
    def _num_expr(c, fill, scale):
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        if c in fill:
            x = F.coalesce(x, F.lit(float(fill[c])))
        if scale is not None:
            m, s = scale[c]
            x = (x - F.lit(m)) / F.lit(s)
        return x


class PreprocessModel(Model, SavedState):
    """Fitted preprocessing: ``transform`` adds the feature vector; category columns become their cleaned strings."""

    def __init__(self, spec: Preprocess | None = None, num_fill=None, scale=None, cat_fill=None,
                 vocabulary: Vocabulary | None = None, encoder=None) -> None:
        super().__init__()
        self.spec, self.num_fill, self.scale, self.cat_fill = spec, num_fill, scale, cat_fill
        self.vocabulary, self.encoder = vocabulary, encoder

    def _transform(self, df: DataFrame) -> DataFrame:
        sp = self.spec
        out = df.withColumns({f"{c}__num": Preprocess._num_expr(c, self.num_fill, self.scale)
                              for c in sp.numeric_cols})
        inputs = [f"{c}__num" for c in sp.numeric_cols]
        if sp.categorical_cols:
            def cleaned(c):
                e = clean_category(c, sp.strip_quotes, sp.null_token)
                fill = self.cat_fill.get(c)
                return e if fill is None else F.coalesce(e, F.lit(fill))
            # categories are replaced in place by their cleaned strings
            out = out.withColumns({c: cleaned(c) for c in sp.categorical_cols})
            if sp.categorical == "onehot":
                out = self.encoder.transform(self.vocabulary.encode(out, sp.categorical_cols, "__idx", None))
                inputs += [c + "__oh" for c in sp.categorical_cols]
            else:
                out = self.vocabulary.encode(out, sp.categorical_cols, "__ord")
                inputs += [c + "__ord" for c in sp.categorical_cols]
        assembler = VectorAssembler(inputCols=inputs, outputCol=sp.output, handleInvalid="keep")
        res = assembler.transform(out)
        helper = [c for c in res.columns if c.endswith(("__num", "__idx", "__oh", "__ord"))]
        return res.drop(*helper)

    def feature_names(self, spark) -> DataFrame:
        """(place, Feature) of every feature; a one-hot feature is named ``column=value``."""
        sp = self.spec
        names = list(sp.numeric_cols) + ([] if sp.categorical == "onehot" else list(sp.categorical_cols))
        out = spark.createDataFrame(list(enumerate(names)), "place long, Feature string")
        if sp.categorical == "onehot" and sp.categorical_cols:
            offsets, at = [], len(names)
            for c in sp.categorical_cols:
                offsets.append((c, at))
                at += max(self.vocabulary.sizes[c], 1)
            first = F.broadcast(spark.createDataFrame(offsets, "variable string, first long"))  # a row a column
            out = out.unionByName(self.vocabulary.table.join(first, "variable").select(
                (F.col("first") + F.col("code")).alias("place"), F.concat_ws("=", "variable", "value").alias("Feature")))
        return out

    def state(self) -> dict:
        return {"spec": asdict(self.spec), "num_fill": self.num_fill, "scale": {c: list(v) for c, v in self.scale.items()},
                "cat_fill": self.cat_fill, "sizes": self.vocabulary.sizes if self.vocabulary else None}

    def restore(self, state: dict) -> None:
        self.spec = Preprocess(**state["spec"])
        self.num_fill, self.cat_fill = state["num_fill"], state["cat_fill"]
        self.scale = {c: tuple(v) for c, v in state["scale"].items()}
        self.sizes = state["sizes"]

    def tables(self) -> dict:
        return {"vocabulary": self.vocabulary.table} if self.vocabulary else {}

    def restore_table(self, name: str, table: DataFrame) -> None:
        self.vocabulary = Vocabulary(table, self.sizes)

    def parts(self) -> dict:
        return {"encoder": self.encoder} if self.encoder else {}

    def restore_part(self, name: str, part) -> None:
        self.encoder = part
