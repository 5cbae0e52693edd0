"""Random forests, grown data-parallel by Spark ML.

What the learner has no equivalent for: maxnodes, cutoff, strata, proximity,
local and permutation importance, out-of-bag figures and unsupervised mode.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import RFormula, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.index import RID
from gridloom.objects import DFrame, Table


@dataclass
class Forest:
    classes: list[str] | None
    model: object
    prepare: object
    features: list[str]
    importance: list[float]

    def predict(self, x: Table) -> DataFrame:
        """__rid, prediction: a class or a number."""
        got = self.model.transform(self.prepare(x.df))
        value = F.col("prediction")
        if self.classes is not None:
            value = F.element_at(F.array(*map(F.lit, self.classes)), (value + 1).cast("int"))
        return got.select(RID, value.alias("prediction"))

    def confusion(self, x: Table, label: str) -> DataFrame:
        """label, prediction, n (of the rows given, not out of bag)."""
        rows = self.predict(x).join(x.df.select(RID, F.col(label).alias("label")), RID)
        return rows.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def random_forest(data: DFrame, label: str | None = None, formula: str | None = None, ntree: int = 500, mtry: int | None = None, nodesize: int | None = None, sampsize: float = 1.0, replace: bool = True, max_depth: int = 12, seed: int = 0) -> Forest:
    """A classifier where the label is text or boolean, else a regression.

    formula: "y ~ a + b" or "y ~ .".  mtry defaults to the root of the number of
    features or to a third of it, nodesize to 1 or 5.
    """
    if ntree < 1:
        raise ValueError("at least one tree is needed")
    if (label is None) == (formula is None):
        raise ValueError("give a label or a formula")
    df = data.df.select(RID, *(F.col(f"`{c}`") for c in data.columns))
    if formula is not None:
        label = formula.split("~")[0].strip()
        fitted = RFormula(formula=formula.replace("~ .", f"~ . - {RID}"), featuresCol="_features", labelCol="_ignored", forceIndexLabel=False).fit(df)
        prepare = lambda d: fitted.transform(d if label in d.columns else d.withColumn(label, F.lit(None)))
        features = formula.split("~")[1].split("+")
    else:
        features = [c for c in data.columns if c != label]
        kinds = {f.name: f.dataType for f in df.schema}
        text = [c for c in features if isinstance(kinds[c], T.StringType)]
        indexer = StringIndexer(inputCols=text, outputCols=[f"_{c}" for c in text], handleInvalid="keep").fit(df) if text else None
        assembler = VectorAssembler(inputCols=[f"_{c}" if c in text else c for c in features], outputCol="_features")
        prepare = lambda d: assembler.transform(indexer.transform(d) if indexer else d)
    kind = {f.name: f.dataType for f in df.schema}[label]
    classify = isinstance(kind, (T.StringType, T.BooleanType))
    width = len(prepare(df).select("_features").first()[0])
    tries = mtry if mtry is not None else math.floor(math.sqrt(width)) if classify else max(1, width // 3)
    if not 1 <= tries <= width:
        warnings.warn(f"mtry is set between 1 and {width}", stacklevel=2)
    tries = min(max(tries, 1), width)
    settings = dict(featuresCol="_features", labelCol="_label", numTrees=ntree, featureSubsetStrategy=str(tries), minInstancesPerNode=nodesize or (1 if classify else 5), subsamplingRate=sampsize, bootstrap=replace, maxDepth=max_depth, seed=seed)
    ready = prepare(df).where(F.col(label).isNotNull())
    classes = None
    if classify:
        classes = [r[0] for r in ready.select(F.col(label).cast("string")).distinct().orderBy(label).collect()]
        ready = ready.withColumn("_label", (F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("string")) - 1).cast("double"))
        model = RandomForestClassifier(**settings).fit(ready)
    else:
        model = RandomForestRegressor(**settings).fit(ready.withColumn("_label", F.col(label).cast("double")))
    return Forest(classes, model, prepare, features, list(model.featureImportances.toArray()))
