"""Requests as JSON: decoded with an explicit schema; one bad item rejects its whole batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacorn.functions import ledger as L
from abacorn.functions import money as M

ITEM = "id STRING, debit_account_id STRING, credit_account_id STRING, amount STRING, idempotency_key STRING, user_data STRING, ledger BIGINT, code INT, flags BIGINT, timeout_ns DECIMAL(20,0)"


def decode(item: Column) -> Column:
    """An item's fields in the data model's types; fields that don't parse are null."""
    return F.struct(
        L.parse_id(item["id"]).alias("transfer_id"), L.parse_id(item["debit_account_id"]).alias("debit_account_id"), L.parse_id(item["credit_account_id"]).alias("credit_account_id"), M.parse(item["amount"]).alias("amount"),
        L.idempotency_key(item["idempotency_key"]).alias("idempotency_key"), L.parse_user_data(F.coalesce(item["user_data"], F.lit(""))).alias("user_data"), F.coalesce(item["ledger"], F.lit(0)).alias("ledger"),
        F.coalesce(item["code"], F.lit(0)).alias("code"), F.coalesce(item["flags"], F.lit(0)).alias("flags"), F.coalesce(item["timeout_ns"], F.lit(0)).cast("decimal(20,0)").alias("timeout_ns"),
    )


def batches(requests: DataFrame) -> DataFrame:
    """requests (batch_id, body: a JSON array) as items (batch_id, idx, ok, item): ok is false for all items of a batch with a bad one."""
    parsed = requests.withColumn("items", F.from_json("body", f"ARRAY<STRUCT<{ITEM.replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT').replace(' INT', ': INT').replace(' DECIMAL', ': DECIMAL')}>>"))
    decoded = parsed.withColumn("decoded", F.transform("items", decode))
    sound = lambda x: x["transfer_id"].isNotNull() & x["debit_account_id"].isNotNull() & x["credit_account_id"].isNotNull() & x["amount"].isNotNull()
    checked = decoded.withColumn("ok", F.coalesce(F.forall("decoded", sound), F.lit(False)))
    return checked.select("batch_id", "ok", F.posexplode_outer("decoded").alias("idx", "item"))
