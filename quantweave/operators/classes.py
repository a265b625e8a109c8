"""Class probabilities by an ensemble of forests, refitted as the years go by."""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensemble_probabilities(train: DataFrame, ask: DataFrame, features: list[str], label: str = "cls", classes: int = 10, models: int = 5, trees: int = 20, depth: int = 4, share: float = 0.8, seed: int = 0) -> DataFrame:
    """(t, asset, cls, p) for the rows of `ask`: class probabilities averaged over `models`
    forests, each grown on a drawn share of `train`. Rows with null features are left out;
    a class that training never saw has probability 0."""
    whole = VectorAssembler(inputCols=features, outputCol="_x")
    train = whole.transform(train.dropna(subset=[*features, label]).withColumn("_y", F.col(label).cast("double"))).select("_x", "_y")
    rows = whole.transform(ask.dropna(subset=features)).select("t", "asset", "_x")
    made = None
    for m in range(models):
        part = train.sample(False, share, seed + m)
        model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed + m).fit(part)
        each = model.transform(rows).select("t", "asset", F.posexplode(vector_to_array("probability")).alias("cls", "p"))
        made = each if made is None else made.union(each)
    mean = made.groupBy("t", "asset", "cls").agg((F.sum("p") / models).alias("p"))
    grid = rows.select("t", "asset", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("cls"))
    return grid.join(mean, ["t", "asset", "cls"], "left").select("t", "asset", "cls", F.coalesce("p", F.lit(0.0)).alias("p"))


def walk_forward(rows: DataFrame, features: list[str], starts: list[int], every: int, **options) -> DataFrame:
    """(t, asset, cls, p): for each start, forests grown on the rows before it whose outcome is
    known then, asked for the `every` periods from it on."""
    made = None
    for start in starts:
        before = rows.where((F.col("t_idx") < start - 1) & F.col("cls").isNotNull())
        after = rows.where((F.col("t_idx") >= start) & (F.col("t_idx") < start + every))
        one = ensemble_probabilities(before, after, features, **options)
        made = one if made is None else made.union(one)
    return made
