"""Fixed rules on streams: binarizing and scoring keep no state, so they are the same projections as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.functions.rules import Rule
from rulewright.operators.binarize import BinarizerModel


def predict(df: DataFrame, model: BinarizerModel, rule: Rule, name: str = "pred") -> DataFrame:
    """df, batch or stream, with the rule's prediction; only the columns that the rule names are tested."""
    by_index = {f.index: f for f in model.features}

    def column(node: Rule):
        if not node.children:
            c = by_index[node.value].column()
        else:
            parts = [column(c) for c in node.children]
            c = parts[0]
            for p in parts[1:]:
                c = c & p if type(node).__name__ == "And" else c | p
        return ~c if node.negated else c

    return df.withColumn(name, column(rule))


def confusion_over_time(stream: DataFrame, time: str, pred: str, label: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Confusion counts of predictions by window of event time, late rows dropped past the watermark."""
    p, y = F.col(pred), F.col(label)
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window))
        .agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    )
