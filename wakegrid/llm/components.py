"""Connected components of a table of links, in rounds that are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in ``links``; a component is named by its smallest id.

    Each round takes the smallest name among the neighbours and then the name
    that this name has got, so names travel in leaps.  ``links`` is read in every
    round and should be a written table.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("to")).union(links.select(F.col(b), F.col(a))).where("id <> to")
    names = kept(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("component")), "names")
    while True:
        near = both.join(names.select(F.col("id").alias("to"), F.col("component").alias("near")), "to").groupBy("id").agg(F.min("near").alias("near"))
        lower = names.join(near, "id").select("id", "component", F.least("component", "near").alias("lower"))
        beyond = names.select(F.col("id").alias("lower"), F.col("component").alias("beyond"))
        new = lower.join(beyond, "lower").select("id", F.least("lower", "beyond").alias("component"), (F.least("lower", "beyond") < F.col("component")).alias("moved"))
        new = kept(new, "names")
        names = new.select("id", "component")
        if not new.where("moved").head(1):
            return names
