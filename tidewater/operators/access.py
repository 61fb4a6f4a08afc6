"""Who may see or change rows: semi-joins with a table of roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def having_role(users: DataFrame, roles: DataFrame, role: str = "admin") -> DataFrame:
    """users (user_id, ...) who have a role; roles (user_id, role)."""
    return users.join(roles.where(F.col("role") == role).select("user_id"), "user_id", "left_semi")


def visible(rows: DataFrame, requests: DataFrame, roles: DataFrame, public: str = "is_public") -> DataFrame:
    """Each request (request_id, user_id, row_id) with the row that it asks for (row_id, ...), if that is public or the user is an admin."""
    admins = roles.where("role = 'admin'").select("user_id", F.lit(True).alias("_admin")).distinct()
    return requests.join(rows, "row_id").join(admins, "user_id", "left").where(F.col(public) | F.coalesce("_admin", F.lit(False))).drop("_admin")
