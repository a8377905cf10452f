"""Partner graphs and brackets."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.registry import query
from courtside.operators.brackets import bracket
from courtside.functions.probability import SIGMOID, sigmoid
from courtside.operators.graph import connected_components
from courtside.sources.tables import GAMES, games, table

_PARTNERS = "e as (select distinct context, a1 a, a2 b from games union select context, b1, b2 from games)"
_REACH = """both_ways as (select * from e union select context, b, a from e),
r(context, node, lab) as (select context, a, a from both_ways union select r.context, b.b, r.lab from r join both_ways b on b.context = r.context and b.a = r.node),
c as (select context, node, min(lab) component from r group by all)"""


def _components(edges: DataFrame) -> DataFrame:
    """edges: context, a, b. (context, node, component)."""
    node = lambda p: F.struct("context", F.col(p).alias("id"))
    found = connected_components(edges.select(node("a").alias("a"), node("b").alias("b")))
    return found.select("node.context", F.col("node.id").alias("node"), F.col("component.id").alias("component"))


def _edges(spark: SparkSession, sf_dir: str, *pairs: tuple[str, str]) -> DataFrame:
    return games(spark, sf_dir).select("context", F.inline(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs)))).distinct()


@query(f"with recursive {GAMES}, {_PARTNERS}, {_REACH} select * from c")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is connected through partners, in each context."""
    return _components(_edges(spark, sf_dir, ("a1", "a2"), ("b1", "b2")))


@query(f"with recursive {GAMES}, e as (select distinct context, a1 a, a2 b from games union select context, a2, b1 from games union select context, b1, b2 from games), {_REACH} select * from c")
def opponent_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is connected through partners or opponents: a chain through a game's four players does for all its pairs."""
    return _components(_edges(spark, sf_dir, ("a1", "a2"), ("a2", "b1"), ("b1", "b2")))


@query(f"""with recursive {GAMES}, {_PARTNERS}, {_REACH}, s as (select context, component, count(*) n, bool_or(node = 100) focal from c group by all)
select context, count(*) components, max(n) largest, round(max(n) / sum(n), 6) giant, coalesce(max(case when focal then n end), 0) focal from s group by context""")
def component_sizes(spark: SparkSession, sf_dir: str, focal: int = 100) -> DataFrame:
    """Of each context: how many components, the largest, its share, and the size of a given player's."""
    s = components(spark, sf_dir).groupBy("context", "component").agg(F.count("*").alias("n"), F.bool_or(F.col("node") == focal).alias("focal"))
    return s.groupBy("context").agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("giant"), F.coalesce(F.max(F.when(F.col("focal"), F.col("n"))), F.lit(0)).alias("focal"))


#: Where the seeds 1 to 8 stand in a bracket, so that the best meet last.
_SPOT = {1: 0, 8: 1, 4: 2, 5: 3, 2: 4, 7: 5, 3: 6, 6: 7}
_SPOT_SQL = "case seed " + " ".join(f"when {s} then {at}" for s, at in _SPOT.items()) + " end"


def _round_sql(k: int) -> str:
    return f"r{k} as (select x.pool, x.id, x.spot, x.v, x.p * sum(y.p * {SIGMOID.format(x='(x.v - y.v)')}) p from r{k - 1} x join r{k - 1} y on x.pool = y.pool and xor(x.spot // {2 ** (k - 1)}, 1) = y.spot // {2 ** (k - 1)} group by x.pool, x.id, x.spot, x.v, x.p)"


@query(f"""with s as (select n_regionkey pool, s_suppkey id, s_acctbal / 4000.0 v, row_number() over (partition by n_regionkey order by s_acctbal desc, s_suppkey) seed from supplier join nation on s_nationkey = n_nationkey),
r0 as (select pool, id, v, {_SPOT_SQL} spot, 1.0 p from s where seed <= 8), {', '.join(_round_sql(k) for k in (1, 2, 3))} select r3.pool, r3.id, round(r1.p, 8) last4, round(r2.p, 8) final, round(r3.p, 8) title from r3 join r2 using (id) join r1 using (id)""")
def bracket_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top eight of each pool through a seeded bracket: a level at a time, each against those it can meet there."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    w = Window.partitionBy("pool").orderBy(F.desc("s_acctbal"), "s_suppkey")
    seeded = s.join(n, s.s_nationkey == n.n_nationkey).withColumnRenamed("n_regionkey", "pool").select("pool", F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 4000.0).alias("v"), F.row_number().over(w).alias("seed")).where("seed <= 8")
    spot = F.create_map(*(F.lit(x) for pair in _SPOT.items() for x in pair))
    at = seeded.select("pool", "id", "v", spot[F.col("seed")].alias("spot"), F.lit(1.0).alias("p"))
    names = ["last4", "final", "title"]
    for k, name in enumerate(names):
        half = F.shiftright("spot", k)
        y = at.select("pool", half.bitwiseXOR(F.lit(1)).alias("half"), F.col("v").alias("v2"), F.col("p").alias("p2"))
        met = at.withColumn("half", half).join(y, ["pool", "half"])
        at = met.groupBy("pool", "id", "v", "spot", *names[:k], F.col("p").alias("was")).agg(F.sum(F.col("p2") * sigmoid(F.col("v") - F.col("v2"))).alias("beat")).withColumn("p", F.col("was") * F.col("beat")).withColumn(name, F.round("p", 8)).drop("was", "beat")
    return at.select("pool", "id", *names)


def _bye_sql(k: int) -> str:
    return f"q{k} as (select x.pool, x.id, x.v, x.spot, x.rounds, x.p * coalesce(sum(y.p * {SIGMOID.format(x='(x.v - y.v)')}), 1.0) p from q{k - 1} x left join q{k - 1} y on x.pool = y.pool and xor(x.spot // {2 ** (k - 1)}, 1) = y.spot // {2 ** (k - 1)} where x.rounds >= {k} group by x.pool, x.id, x.v, x.spot, x.rounds, x.p)"


_PLACES = {r: "[" + ", ".join(map(str, p)) + "]" for r, p in ((1, [1, 2]), (2, [1, 4, 2, 3]), (3, [1, 8, 4, 5, 2, 7, 3, 6]), (4, [1, 16, 8, 9, 4, 13, 5, 12, 2, 15, 7, 10, 3, 14, 6, 11]))}


@query(f"""with s as (select s_nationkey pool, s_suppkey id, s_acctbal / 4000.0 v, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) seed from supplier),
e as (select * from s where seed <= 5 + pool % 12), z as (select pool, count(*) n, cast(ceil(log2(count(*))) as int) rounds from e group by pool),
q0 as (select pool, id, v, list_position(case rounds {' '.join(f'when {r} then {p}' for r, p in _PLACES.items())} else [1] end, seed) - 1 spot, rounds, 1.0::double p from e join z using (pool)), {', '.join(_bye_sql(k) for k in range(1, 5))}
{' union all '.join(f'select pool, id, {k} "round", round(p, 8) through from q{k}' for k in range(1, 5))}""")
def bracket_byes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brackets of five to sixteen, with byes for the best where places are empty: chances to come through each round."""
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pool"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 4000.0).alias("v"), F.row_number().over(w).alias("seed")).where("seed <= 5 + pool % 12")
    return bracket(s).select("pool", "id", "round", F.round("through", 8).alias("through"))
