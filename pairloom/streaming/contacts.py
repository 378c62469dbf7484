"""Contact counts over a stream of alignments that arrive with both mates in one row: sums commute, so a running count is exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.pairs import classify
from pairloom.params import MapParams


def running_contacts(mates: DataFrame, contigs: DataFrame, params: MapParams) -> DataFrame:
    """(i, j, w) of a stream (or table) of pairs (qname, rec_no, r1, r2); for output mode update or complete."""
    return classify(mates, contigs, params).where("reason = 'accepted'").groupBy("i", "j").agg(F.count("*").alias("w"))
