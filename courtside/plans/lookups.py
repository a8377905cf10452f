"""Joins: lookups with defaults, pairs, as-of, semi and anti, nearest, either way round."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.registry import query
from courtside.operators.joins import as_of_backward, as_of_clamped, self_join_other_side
from courtside.sources.storage import written
from courtside.sources.tables import GAMES, RALLIES, RATING, SLOTS, games, rallies, rating, slots, table


@query("""select o_orderkey, coalesce(c_name, substr(cast(o_custkey as varchar), 1, 8)) who from orders left join (select * from customer where c_acctbal > 0) on c_custkey = o_custkey""")
def dim_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name by id, else the id's first eight characters. The dimension's size decides how Spark joins it."""
    orders, named = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal > 0")
    who = F.coalesce("c_name", F.substring(F.col("o_custkey").cast("string"), 1, 8))
    return orders.join(named, orders.o_custkey == named.c_custkey, "left").select("o_orderkey", who.alias("who"))


_VALUES = f"v as (select distinct player, {RATING.format(p='player')} val from slots where player % 10 <> 3)"


@query(f"""with {GAMES}, {SLOTS}, {_VALUES}, g as (select gid, round(sum(case when side = 1 then val else -val end), 6) + 0.0 eta, count(*) n from slots join v using (player) group by gid)
select gid, eta from g where n = 4""")
def star4_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four players' values for each game, and the sides' difference; games with an unrated player go."""
    every = slots(games(spark, sf_dir)).select("gid", "player", "side")
    values = every.select("player").distinct().where("player % 10 <> 3").select("player", rating(F.col("player")).alias("val"))
    eta = F.sum(F.when(F.col("side") == 1, F.col("val")).otherwise(-F.col("val")))
    return every.join(values, "player").groupBy("gid").agg((F.round(eta, 6) + 0.0).alias("eta"), F.count("*").alias("n")).where("n = 4").drop("n")


@query(f"""with {GAMES}, chem as (select least(a1, a2) p, greatest(a1, a2) q, round(avg(margin), 6) chem from games where tour = 'MLP' group by all)
select gid, coalesce(chem, 0) chem from games left join chem on p = least(a1, a2) and q = greatest(a1, a2) where tour = 'PPA'""")
def pair_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair's value whichever way round it is named, 0 for an unknown pair."""
    keyed = games(spark, sf_dir).select("gid", "tour", "margin", F.array_sort(F.array("a1", "a2")).alias("pair"))
    chem = keyed.where("tour = 'MLP'").groupBy("pair").agg(F.round(F.avg("margin"), 6).alias("chem"))
    return keyed.where("tour = 'PPA'").join(chem, "pair", "left").select("gid", F.coalesce("chem", F.lit(0.0)).alias("chem"))


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.max("o_totalprice").alias("v"))


_MONTHS = "m as (select o_custkey k, strftime(o_orderdate, '%Y-%m') \"month\", max(o_totalprice) v from orders group by all)"


@query(f"""with {_MONTHS}, ends as (select k, min("month") lo, arg_min(v, "month") first_v, arg_max(v, "month") last_v from m group by k)
select o_orderkey, coalesce(m.v, case when strftime(o_orderdate, '%Y-%m') < lo then first_v else last_v end) v
from orders join ends e on e.k = o_custkey left join m on m.k = o_custkey and m."month" = strftime(o_orderdate, '%Y-%m')""")
def asof_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's value of an order's month; before the first month the first, otherwise the last."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return as_of_clamped(o, _months(spark, sf_dir), "k", "month", "v").select("o_orderkey", "v")


@query(f"""with {_MONTHS}, o as (select o_orderkey, o_custkey k, strftime(o_orderdate, '%Y-%m') "month" from orders),
firsts as (select k, arg_min(v, "month") first_v from m group by k)
select o_orderkey, coalesce(m.v, first_v) v from o asof left join m on o.k = m.k and o."month" >= m."month" join firsts f on f.k = o.k""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value up to a month, else the first one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    months = _months(spark, sf_dir)
    firsts = months.groupBy("k").agg(F.min_by("v", "month").alias("first_v"))
    return as_of_backward(o, months, "k", "month", "v").join(firsts, "k").select("o_orderkey", F.coalesce("v", "first_v").alias("v"))


@query(f"""with {GAMES}, {SLOTS}, t as (select match_id, side, sum(pf) pf from slots group by all)
select a.match_id, a.side, a.pf, b.pf other_pf from t a join t b on a.match_id = b.match_id and a.side <> b.side""", pf="bigint", other_pf="bigint")
def other_side_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side's points beside the other side's of the same match."""
    t = slots(games(spark, sf_dir)).groupBy("match_id", "side").agg(F.sum("pf").alias("pf"))
    return self_join_other_side(t, "match_id", "side", {"pf": "other_pf"})


@query("select a.n_nationkey a, b.n_nationkey b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey")
def ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered pairs of teams of a pool (a pool is a region, the join is by it)."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("a")), n.select("n_regionkey", F.col("n_nationkey").alias("b"))
    return a.join(b, "n_regionkey").where("a <> b").select("a", "b")


@query("select a.n_nationkey a, b.n_nationkey b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def unordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_pairs(spark, sf_dir).where("a < b")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_shipdate < timestamp '1998-01-01')")
def incremental_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with nothing harvested yet."""
    done = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp_ntz '1998-01-01 00:00:00'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query(f"with {GAMES}, {SLOTS} select context, count(*) n from games where match_id in (select match_id from slots where player in (5, 105, 205)) group by context")
def focal_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of matches that a player of interest took part in."""
    g = games(spark, sf_dir)
    focal = slots(g).where(F.col("player").isin(5, 105, 205)).select("match_id")
    return g.join(focal, "match_id", "left_semi").groupBy("context").agg(F.count("*").alias("n"))


@query("""with p as (select o_custkey k, cast(o_orderdate as date) d, min(o_orderkey) id from orders where o_orderstatus = 'F' group by all),
q as (select o_orderkey, o_custkey k, cast(o_orderdate as date) d from orders where o_orderstatus <> 'F')
select o_orderkey, case when date_diff('day', p.d, q.d) <= 60 then p.id end prev_id from q asof left join p on p.k = q.k and q.d >= p.d""")
def latest_within_60d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest completed order of the customer, unless it is more than 60 days back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"), "o_orderstatus")
    done = o.where("o_orderstatus = 'F'").groupBy("k", "d").agg(F.min("o_orderkey").alias("id"))
    found = as_of_backward(o.where("o_orderstatus <> 'F'"), done.select("k", "d", F.struct("d", "id").alias("last")), "k", "d", "last")
    return found.select("o_orderkey", F.when(F.datediff("d", "last.d") <= 60, F.col("last.id")).alias("prev_id"))


@query("select o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).k last_order, arg_max(o_totalprice, struct_pack(d := o_orderdate, k := o_orderkey)) total from orders group by o_custkey")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(last)["o_orderkey"].alias("last_order"), F.max_by("o_totalprice", last).alias("total"))


@query("""select s_suppkey, c_custkey from (select s_suppkey, c_custkey, row_number() over (partition by s_suppkey order by abs(s_acctbal - c_acctbal), c_custkey) r
from supplier join customer on s_nationkey = c_nationkey) where r = 1""")
def nearest_value_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the candidates under a shared name, the one with the nearest value; of equally near ones the least key.

    Both sides lie on one line by name and value, cut into ranges: within a range the nearest candidate is the last one before or the first one after, and
    beyond it the last of the ranges before or the first of those after, of which there is a row each. No pairs, and no name is one task.
    """
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("name"), F.col("s_acctbal").alias("v"), F.lit(None).cast("long").alias("c"), "s_suppkey")
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("name"), F.col("c_acctbal").alias("v")).agg(F.min("c_custkey").alias("c")).withColumn("s_suppkey", F.lit(None).cast("long"))
    order = ["name", "v", "s_suppkey"]
    line = written(s.unionByName(c).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "line")
    at = F.when(F.col("c").isNotNull(), F.struct("name", "v", "c"))
    own = Window.partitionBy("range")
    last = lambda w: F.last(at, ignorenulls=True).over(w)
    # a row a range
    ends = line.groupBy("range").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    beside = Window.orderBy("range")
    ends = ends.select("range", F.last("hi", ignorenulls=True).over(beside.rowsBetween(Window.unboundedPreceding, -1)).alias("left"), F.first("lo", ignorenulls=True).over(beside.rowsBetween(1, Window.unboundedFollowing)).alias("right"))
    up = own.orderBy("name", "v", F.col("c").isNull(), "s_suppkey")
    down = own.orderBy(F.desc("name"), F.desc("v"), F.col("c").isNull(), "s_suppkey")
    seen = line.withColumn("below", last(up)).withColumn("above", last(down)).where("s_suppkey is not null").join(F.broadcast(ends), "range")
    near = [F.when(F.col(f"{n}.name") == F.col("name"), F.struct(F.abs(F.col("v") - F.col(f"{n}.v")).alias("d"), F.col(f"{n}.c").alias("c"))) for n in ("below", "above", "left", "right")]
    return seen.select("s_suppkey", F.array_min(F.array_compact(F.array(*near))).alias("best")).where("best is not null").select("s_suppkey", F.col("best.c").alias("c_custkey"))


#: Letters of a word that names are searched for; the rest is compared in the names that have them.
ANCHOR = 8


@query("""with names as (select p_partkey id, lower(p_name) name from part), wants as (select distinct split_part(name, ' ', -1) || ' ' || split_part(name, ' ', 1) want from names union select 'unheard of ' || split_part(name, ' ', -1) from names),
tk as (select want, unnest(string_split(want, ' ')) token from wants), hits as (select want, id from wants join names on list_bool_and([contains(name, t) for t in string_split(want, ' ')])),
h as (select want, count(*) n, min(id) id from hits group by want), l as (select want, count(*) n, min(id) id from wants join names on list_contains(string_split(name, ' '), split_part(want, ' ', -1)) group by want)
select wants.want, case when h.n = 1 or h.n is null and l.n = 1 then coalesce(h.id, l.id) end id, case when h.n = 1 then 'token' when h.n > 1 then 'ambiguous' when l.n = 1 then 'last name' when l.n > 1 then 'ambiguous last name' else 'not found' end how, coalesce(h.n, l.n, 0) hits
from wants left join h using (want) left join l using (want)""")
def token_contain_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom a name means: the one who has all its words somewhere in theirs, else the one with its last word; several or none are said to be so.

    The longest word of those asked for is looked for by an equi-join of its first ANCHOR letters with all stretches of names of up to as many letters, so
    nobody is compared with everybody; the other words are then looked for in the names that have it.
    """
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"))
    words = F.split("name", " ")
    wants = names.select(F.concat_ws(" ", F.element_at(words, -1), words[0]).alias("want")).union(names.select(F.concat(F.lit("unheard of "), F.element_at(words, -1)))).distinct()
    asked = F.split("want", " ")
    longest = F.array_max(F.transform(asked, lambda t: F.struct(F.length(t).alias("n"), t.alias("word"))))["word"]
    texts = names.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    pieces = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - k + 1, F.lit(1))), lambda i: F.substring("name", i, F.lit(k)))
    cut = F.array_distinct(F.flatten(F.array(*map(pieces, range(1, ANCHOR + 1)))))
    met = wants.withColumn("anchor", F.substring(longest, 1, ANCHOR)).join(texts.select("name", "n", "id", F.explode(cut).alias("anchor")), "anchor")
    hits = met.where(F.forall(asked, lambda t: F.col("name").contains(t))).groupBy("want").agg(F.sum("n").alias("hn"), F.min("id").alias("hid"))
    by_last = texts.select("n", "id", F.explode(F.array_distinct(words)).alias("last"))
    last = wants.withColumn("last", F.element_at(F.split("want", " "), -1)).join(by_last, "last").groupBy("want").agg(F.sum("n").alias("ln"), F.min("id").alias("lid"))
    both = wants.join(hits, "want", "left").join(last, "want", "left")
    how = F.when(F.col("hn") == 1, "token").when(F.col("hn") > 1, "ambiguous").when(F.col("ln") == 1, "last name").when(F.col("ln") > 1, "ambiguous last name").otherwise("not found")
    sure = (F.col("hn") == 1) | (F.col("hn").isNull() & (F.col("ln") == 1))
    return both.select("want", F.when(sure, F.coalesce("hid", "lid")).alias("id"), how.alias("how"), F.coalesce("hn", "ln", F.lit(0)).alias("hits"))


@query(f"""with {GAMES}, f as (select a1 x, b1 y, round(avg(margin), 6) m from games where tour = 'MLP' group by all),
t as (select distinct a1, b1 from games where tour = 'PPA')
select t.a1, t.b1, coalesce(f.m, -r.m) m from t left join f on f.x = t.a1 and f.y = t.b1 left join f r on r.x = t.b1 - 200 and r.y = t.a1 + 200""")
def either_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pairing's forecast as it was made, or turned round."""
    g = games(spark, sf_dir)
    made = g.where("tour = 'MLP'").groupBy("a1", "b1").agg(F.round(F.avg("margin"), 6).alias("m"))
    turned = made.select((F.col("b1") - 200).alias("a1"), (F.col("a1") + 200).alias("b1"), (-F.col("m")).alias("turned"))
    asked = g.where("tour = 'PPA'").select("a1", "b1").distinct()
    return asked.join(made, ["a1", "b1"], "left").join(turned, ["a1", "b1"], "left").select("a1", "b1", F.coalesce("m", "turned").alias("m"))


@query(f"""with {GAMES}, {SLOTS}, s as (select player, count(*) n, avg(pf - pa) v from slots where context = 'mens' group by player), d as (select player, avg(pf - pa) v from slots where context = 'mixed' group by player),
p as (select distinct player from slots)
select p.player, round(case when coalesce(n, 0) >= 100 then s.v when d.v is not null then -0.07 + 0.8 * d.v end, 6) v, case when coalesce(n, 0) >= 100 then 'own' when d.v is not null then 'imputed' else 'missing' end src
from p left join s using (player) left join d using (player)""")
def fallback_value(spark: SparkSession, sf_dir: str, least: int = 100) -> DataFrame:
    """A player's own value if seen often enough, else one imputed from another discipline, else none, and which it is."""
    every = slots(games(spark, sf_dir))
    own = every.where("context = 'mens'").groupBy("player").agg(F.count("*").alias("n"), F.avg(F.col("pf") - F.col("pa")).alias("own"))
    other = every.where("context = 'mixed'").groupBy("player").agg(F.avg(F.col("pf") - F.col("pa")).alias("other"))
    enough = F.coalesce("n", F.lit(0)) >= least
    both = every.select("player").distinct().join(own, "player", "left").join(other, "player", "left")
    value = F.when(enough, F.col("own")).when(F.col("other").isNotNull(), F.lit(-0.07) + F.lit(0.8) * F.col("other"))
    return both.select("player", F.round(value, 6).alias("v"), F.when(enough, "own").when(F.col("other").isNotNull(), "imputed").otherwise("missing").alias("src"))


@query("""with a as (select l_orderkey, round(sum(l_extendedprice), 2) total from lineitem group by l_orderkey)
select case when a.total is null then 'empty' when abs(a.total - o_totalprice) < 1000 then 'ok' else 'mismatch' end status, count(*) n from orders left join a on l_orderkey = o_orderkey group by 1""")
def score_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals from the parts against the recorded ones."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("total").isNull(), "empty").when(F.abs(F.col("total") - F.col("o_totalprice")) < 1000, "ok").otherwise("mismatch")
    return o.join(parts, o.o_orderkey == parts.l_orderkey, "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"""with {RALLIES}, s as (select match_id, side, count(*) rallies, sum(cast(log_type = 14 as int)) wins from rallies where log_type in (14, 16, 23) group by all)
select a.match_id, a.side, a.rallies serve_rallies, cast(a.wins as bigint) serve_wins, b.rallies return_rallies, cast(b.rallies - b.wins as bigint) return_wins,
round(a.wins / a.rallies, 6) serve_rate, round((b.rallies - b.wins) / b.rallies, 6) return_rate
from s a join s b on a.match_id = b.match_id and a.side <> b.side where a.rallies >= 20""")
def serve_return(spark: SparkSession, sf_dir: str, least: int = 20) -> DataFrame:
    """Serve and return rates: what one side returned is what the other served and did not win."""
    outcome = rallies(spark, sf_dir).where(F.col("log_type").isin(14, 16, 23))
    s = outcome.groupBy("match_id", "side").agg(F.count("*").alias("rallies"), F.count_if(F.col("log_type") == 14).alias("wins"))
    both = self_join_other_side(s, "match_id", "side", {"rallies": "return_rallies", "wins": "lost"})
    return_wins = F.col("return_rallies") - F.col("lost")
    return both.where(F.col("rallies") >= least).select(
        "match_id", "side", F.col("rallies").alias("serve_rallies"), F.col("wins").alias("serve_wins"), "return_rallies", return_wins.alias("return_wins"),
        F.round(F.col("wins") / F.col("rallies"), 6).alias("serve_rate"), F.round(return_wins / F.col("return_rallies"), 6).alias("return_rate"))
