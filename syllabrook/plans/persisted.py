"""Queries over tables that persist: every kind of write, and what each version held."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.plans.registry import query
from syllabrook.session import shared_folder, table
from syllabrook.sources import migrations
from syllabrook.sources.store import Store

#: The state after each commit, as SQL: accounts, orders of unknown accounts, sums merged in, suppliers in place of accounts, deletions.
STEPS = """
with v1 as (select c_custkey id, c_nationkey nation, round(c_acctbal * 100)::bigint balance, 0::bigint n_orders, 0::bigint cents from customer),
first_orders as (select o_custkey + case when o_orderpriority = '1-URGENT' then 1000000 else 0 end id, min_by(o_orderstatus, o_orderkey) status from orders group by 1),
v2 as (select * from v1 union all select id, null, null, null, null from first_orders where id not in (select id from v1)),
sums as (select o_custkey id, count(*) n, sum(round(o_totalprice * 100))::bigint cents from orders group by 1),
v3 as (select coalesce(v2.id, s.id) id, nation, balance, case when v2.id is null then s.n else n_orders + coalesce(s.n, 0) end n_orders, case when v2.id is null then s.cents else v2.cents + coalesce(s.cents, 0) end cents
  from v2 full join sums s on v2.id = s.id),
v4 as (select * from v3 where id not in (select s_suppkey from supplier) union all select s_suppkey, s_nationkey, round(s_acctbal * 100)::bigint, null, null from supplier),
v5 as (select id, nation, case when balance < 0 then 0 else balance end balance, n_orders, cents from v4 where not coalesce(n_orders = 0 and nation < 5, false))
"""


def stored_accounts(spark: SparkSession, sf_dir: str) -> Store:
    """A new store with a commit for each of the steps."""
    read = lambda name: table(spark, sf_dir, name)
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    store = Store(spark, shared_folder(spark))
    c = store.begin()
    c.create("accounts", "id long, nation long, balance long, n_orders long, cents long", ("id",))
    c.insert("accounts", read("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), cents("c_acctbal").alias("balance"), F.lit(0).alias("n_orders"), F.lit(0).alias("cents")), [F.asc("id")])
    c.commit("accounts")
    orders = read("orders")
    c = store.begin()
    c.insert("accounts", orders.select((F.col("o_custkey") + F.when(F.col("o_orderpriority") == "1-URGENT", 1_000_000).otherwise(0)).alias("id"), "o_orderkey"), [F.asc("o_orderkey")])
    c.commit("accounts that only orders know")
    c = store.begin()
    sums = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"), F.sum(cents("o_totalprice")).alias("cents"))
    c.merge("accounts", sums, [F.asc("id")], {x: F.col(f"old.{x}") + F.col(f"new.{x}") for x in ("n_orders", "cents")})
    c.commit("sums of orders")
    c = store.begin()
    c.replace("accounts", read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), cents("s_acctbal").alias("balance")), [F.asc("id")])
    c.commit("suppliers")
    c = store.begin()
    c.delete("accounts", (F.col("n_orders") == 0) & (F.col("nation") < 5))
    c.update("accounts", {"balance": F.lit(0)}, F.col("balance") < 0)
    c.commit("no debts, no empty accounts")
    return store


@query(STEPS + "select * from v5")
def persisted_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts after inserts that ignore, merge and replace, an update and a deletion, each read from what the one before has committed."""
    return stored_accounts(spark, sf_dir).read("accounts")


@query(STEPS + "".join(f"{'union all ' if v > 1 else ''}select {v}::int as version, count(*) n, sum(balance)::bigint balance, sum(cents)::bigint cents from v{v} " for v in range(1, 6)))
def persisted_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version of the accounts held, read back after all writes."""
    store = stored_accounts(spark, sf_dir)
    found = [store.read("accounts", v).agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.sum("balance").alias("balance"), F.sum("cents").alias("cents")) for v in store.versions()]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


@query("select n_regionkey region, count(*) n, count(distinct n_name[1:1]) initials, 2::bigint n_migrations from nation group by 1")
def migrated_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made and widened by migrations, run twice, with the number of rows that their ledger has."""
    store = Store(spark, shared_folder(spark))

    def fill(change) -> bool:
        new = change.add_column("nations", "initial", "string")
        rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"))
        change.insert("nations", rows.withColumn("initial", F.substring("name", 1, 1)), [F.asc("id")])
        return new

    steps = [migrations.from_file("m001", "CREATE TABLE nations (id INTEGER PRIMARY KEY, region INTEGER, name TEXT);"), migrations.Migration("m002", "initials", fill)]
    for _ in range(2):
        migrations.migrate(store, steps)
    ledger = store.read(migrations.LEDGER).agg(F.count("*").alias("n_migrations"))
    return store.read("nations").groupBy("region").agg(F.count("*").alias("n"), F.count_distinct("initial").alias("initials")).join(F.broadcast(ledger))
