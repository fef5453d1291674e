"""Which experiments a user sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def visible(users: DataFrame, experiments: DataFrame, projects: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, experiment_id, access_level): all for admins (MANAGER), else the project's level if there is one, else the grant.

    users: user_id, is_admin; experiments: experiment_id, project_id; projects: user_id, project_id, access_level; grants:
    user_id, experiment_id, access_level. Members see all experiments of a project, so the result is far larger than the tables:
    it is made by one join and not shuffled; only grants are compared with it. Grants that a project's level hides do not count,
    however many there are of one pair.
    """
    parts = int(projects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = users.filter(~F.col("is_admin"))
    members = projects.join(others, "user_id", "left_semi").withColumnRenamed("access_level", "project_level")
    direct = grants.join(others, "user_id", "left_semi").select("user_id", "experiment_id", F.col("access_level").alias("direct_level"))
    # the grants of what a project shows as well; a level of the project hides theirs
    both = direct.join(experiments, "experiment_id").join(members, ["user_id", "project_id"]).select("user_id", "experiment_id", "project_level", "direct_level")
    alone = direct.join(both, ["user_id", "experiment_id"], "left_anti").select("user_id", "experiment_id", F.col("direct_level").alias("access_level"))
    # members are dealt out by user, as a few tasks may have read them and each becomes many rows
    spread = members.repartition(parts, "user_id", "project_id")
    shown = F.broadcast(experiments) if experiments.count() <= BROADCAST_ROWS else experiments
    leveled = spread.filter("project_level is not null").join(shown, "project_id").select("user_id", "experiment_id", F.col("project_level").alias("access_level"))
    bare = spread.filter("project_level is null").join(shown, "project_id").join(direct, ["user_id", "experiment_id"], "left").select("user_id", "experiment_id", F.col("direct_level").alias("access_level"))
    # by definition every admin with every experiment, so the result holds that many rows; they are dealt out by experiment
    admins = users.filter("is_admin").groupBy(F.lit(1).alias("one")).agg(F.collect_set("user_id").alias("admins"))
    every = experiments.repartition(parts, "experiment_id").withColumn("one", F.lit(1)).join(F.broadcast(admins), "one").select(F.explode("admins").alias("user_id"), "experiment_id", F.lit("MANAGER").alias("access_level"))
    return leveled.unionByName(bare).unionByName(alone).unionByName(every)
