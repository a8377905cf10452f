"""Aggregates: records, partners, names, bins, rates, standings, forecast scores."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.registry import query
from courtside.functions.probability import SIGMOID, logit, sigmoid
from courtside.sources.tables import GAMES, RATING, SLOTS, games, rating, slots, table


@query(f"""with {GAMES}, {SLOTS} select player, count(*) games, sum(won) wins, count(*) - sum(won) losses, sum(pf) pf, sum(pa) pa,
count(*) filter (where context = 'mixed') mixed, count(*) filter (where tour = 'MLP') mlp, count(*) filter (where (best_of, game_no) in ((3, 3), (5, 5))) deciding,
count(*) filter (where greatest(pf, pa) > target) overtime, count(*) filter (where target = 11 and won = 1 and pa <= 5) blowouts from slots where not is_forfeit group by player""", wins="bigint", losses="bigint", pf="bigint", pa="bigint")
def player_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a player's counters in one aggregate over the four-way expansion."""
    c = F.col
    return slots(games(spark, sf_dir).where(~c("is_forfeit"))).groupBy("player").agg(
        F.count("*").alias("games"), F.sum("won").alias("wins"), (F.count("*") - F.sum("won")).alias("losses"), F.sum("pf").alias("pf"), F.sum("pa").alias("pa"),
        F.count_if(c("context") == "mixed").alias("mixed"), F.count_if(c("tour") == "MLP").alias("mlp"),
        F.count_if((c("best_of") == c("game_no")) & c("best_of").isin(3, 5)).alias("deciding"), F.count_if(F.greatest("pf", "pa") > c("target")).alias("overtime"),
        F.count_if((c("target") == 11) & (c("won") == 1) & (c("pa") <= 5)).alias("blowouts"))


@query(f"with {GAMES}, {SLOTS} select player, context, count(distinct partner) partners from slots group by all union all select player, 'all', count(distinct partner) from slots group by player")
def distinct_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners in each context and in all: the distinct triples first, then both counts."""
    t = slots(games(spark, sf_dir)).select("player", "context", "partner").distinct()
    return t.groupBy("player", "context").agg(F.count("*").alias("partners")).unionByName(t.groupBy("player").agg(F.countDistinct("partner").alias("partners")).withColumn("context", F.lit("all")))


@query("""with c as (select p_size, p_brand nm, count(*) n, min(p_partkey) seen from part group by all)
select p_size, arg_max(nm, struct_pack(n := n, s := -seen)) canonical, list_sort(list(nm)) variants, count(*) > 1 needs_review from c group by p_size""")
def canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent name of an id, of equals the first seen; and all its variants."""
    c = table(spark, sf_dir, "part").groupBy("p_size", F.col("p_brand").alias("nm")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("seen"))
    return c.groupBy("p_size").agg(F.max_by("nm", F.struct("n", -F.col("seen"))).alias("canonical"), F.array_sort(F.collect_list("nm")).alias("variants"), (F.count("*") > 1).alias("needs_review"))


@query("select p_brand, list_sort(list(distinct p_type)) variants from part group by p_brand")
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("variants"))


@query(f"with {GAMES} select tour, game_no, count(*) n, round(avg(margin), 6) mean, round(stddev_samp(margin), 6) sd, round(avg(abs(margin)), 6) mean_abs from games group by all")
def margin_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games(spark, sf_dir).groupBy("tour", "game_no").agg(F.count("*").alias("n"), F.round(F.avg("margin"), 6).alias("mean"), F.round(F.stddev_samp("margin"), 6).alias("sd"), F.round(F.avg(F.abs("margin")), 6).alias("mean_abs"))


@query(f"with {GAMES}, d as (select context, least(a1, a2) p, greatest(a1, a2) q, count(*) n from games group by all) select context, cast(median(n) as double) median_games, count(*) dyads, count(*) filter (where n >= 5) often from d group by context")
def median_dyad(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = games(spark, sf_dir).groupBy("context", F.least("a1", "a2").alias("p"), F.greatest("a1", "a2").alias("q")).agg(F.count("*").alias("n"))
    return d.groupBy("context").agg(F.median("n").alias("median_games"), F.count("*").alias("dyads"), F.count_if(F.col("n") >= 5).alias("often"))


_BINS = [(0, 2), (2, 4), (4, 6), (6, 8), (8, 11), (11, 16), (16, 99)]


@query(f"""with {GAMES}, b(lo, hi) as (values {', '.join(map(str, _BINS))}) select lo, hi, count(gid) n from b left join games on abs(margin) >= lo and abs(margin) < hi group by all""")
def margin_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by bin [lo, hi), empty bins kept: games are counted by bin first, then joined to the bins."""
    bins = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(_BINS)], "bin int, lo int, hi int")
    at = F.coalesce(*(F.when((F.abs("margin") >= lo) & (F.abs("margin") < hi), k) for k, (lo, hi) in enumerate(_BINS)))
    n = games(spark, sf_dir).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(n, "bin", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"""with {GAMES}, t as (select context, a1 team, cast(margin > 0 as int) won, margin from games union all select context, b1, cast(margin < 0 as int), -margin from games)
select context, team, sum(won) games_won, count(*) - sum(won) games_lost, sum(margin) diff from t group by all""", games_won="bigint", games_lost="bigint", diff="bigint")
def standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda team, sign: F.struct(F.col(team).alias("team"), (F.col("margin") * sign > 0).cast("int").alias("won"), (F.col("margin") * sign).alias("diff"))
    t = games(spark, sf_dir).select("context", F.inline(F.array(side("a1", 1), side("b1", -1))))
    return t.groupBy("context", "team").agg(F.sum("won").alias("games_won"), (F.count("*") - F.sum("won")).alias("games_lost"), F.sum("diff").alias("diff"))


ETA = " + ".join(RATING.format(p=p) for p in ("a1", "a2")) + " - " + " - ".join(RATING.format(p=p) for p in ("b1", "b2"))
FORECASTS = f"""{GAMES}, fc as (select gid, match_id, context, "date", tour, margin, s1, s2, cast(margin > 0 as int) y, {SIGMOID.format(x=f'round({ETA}, 9)')} p from games where not is_forfeit)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with p, the rated chance of side a, and y, whether it won. The sides' difference is rounded, so that equal sides have a chance of 0.5 whatever order they are added in."""
    eta = rating(F.col("a1")) + rating(F.col("a2")) - rating(F.col("b1")) - rating(F.col("b2"))
    return games(spark, sf_dir).where(~F.col("is_forfeit")).select("gid", "match_id", "context", "date", "tour", "margin", "s1", "s2", (F.col("margin") > 0).cast("int").alias("y"), sigmoid(F.round(eta, 9)).alias("p"))


@query(f"""with {FORECASTS} select context, count(*) n, round(avg(cast((p >= 0.5) = (y = 1) as int)), 6) accuracy, round(avg((p - y) * (p - y)), 6) brier,
round(-avg(case y when 1 then ln(greatest(p, 1e-6)) else ln(greatest(1 - p, 1e-6)) end), 6) log_loss, round(avg(abs(margin)), 6) mae0 from fc group by context""")
def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    loss = F.when(y == 1, F.ln(F.greatest(p, F.lit(1e-6)))).otherwise(F.ln(F.greatest(1 - p, F.lit(1e-6))))
    return forecasts(spark, sf_dir).groupBy("context").agg(
        F.count("*").alias("n"), F.round(F.avg(((p >= 0.5) == (y == 1)).cast("int")), 6).alias("accuracy"), F.round(F.avg((p - y) * (p - y)), 6).alias("brier"),
        F.round(-F.avg(loss), 6).alias("log_loss"), F.round(F.avg(F.abs("margin")), 6).alias("mae0"))


@query(f"""with {FORECASTS}, b as (select floor(greatest(p, 1 - p) * 10 + 1e-9) / 10 bucket, cast((p >= 0.5) = (y = 1) as int) hit, greatest(p, 1 - p) f from fc)
select bucket, count(*) n, round(avg(f), 6) said, round(avg(hit), 6) was from b group by bucket""")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    fav = F.greatest("p", 1 - F.col("p"))
    b = forecasts(spark, sf_dir).select((F.floor(fav * 10 + 1e-9) / 10).alias("bucket"), ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int").alias("hit"), fav.alias("f"))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("said"), F.round(F.avg("hit"), 6).alias("was"))


@query(f"""with {FORECASTS} select tour, count(*) n, count(*) filter (where (p >= 0.5) <> (y = 1)) lost, round((count(*) filter (where (p >= 0.5) <> (y = 1)) + 1) / (count(*) + 2), 8) rate from fc where greatest(p, 1 - p) >= 0.8 group by tour""")
def tail_laplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often clear favourites lose, smoothed by one of each."""
    lost = F.count_if((F.col("p") >= 0.5) != (F.col("y") == 1))
    return forecasts(spark, sf_dir).where("greatest(p, 1 - p) >= 0.8").groupBy("tour").agg(F.count("*").alias("n"), lost.alias("lost"), F.round((lost + 1) / (F.count("*") + 2), 8).alias("rate"))


@query(f"with {GAMES} select least(a1, a2) p, greatest(a1, a2) q, count(*) n, sum(cast(margin > 0 as int)) wins from games group by all", wins="bigint")
def pair_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games(spark, sf_dir).groupBy(F.least("a1", "a2").alias("p"), F.greatest("a1", "a2").alias("q")).agg(F.count("*").alias("n"), F.sum((F.col("margin") > 0).cast("int")).alias("wins"))


@query(f"""with {GAMES}, {SLOTS}, own as (select player, case when men > women then 'M' when women > men then 'F' end g from (
select player, count(*) filter (where context = 'mens') men, count(*) filter (where context = 'womens') women from slots group by player)),
beside as (select s.player, count(*) filter (where o.g = 'M') men, count(*) filter (where o.g = 'F') women, count(*) n from slots s join own o on o.player = s.partner where s.context = 'mixed' group by s.player)
select player, coalesce(g, case when men > women then 'F' when women > men then 'M' else 'unknown' end) gender, case when g is not null then 'own' when men <> women then 'partners' else 'none' end known from own left join beside using (player)""")
def gender_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the contexts a player was seen in most; where they don't tell, the opposite of most of the partners in mixed games."""
    s = slots(games(spark, sf_dir))
    c = s.groupBy("player").agg(*(F.count_if(F.col("context") == k).alias(n) for k, n in (("mens", "men"), ("womens", "women"))))
    own = c.select("player", F.when(F.expr("men > women"), "M").when(F.expr("women > men"), "F").alias("g"))
    partners = s.where("context = 'mixed'").groupBy("player", "partner").agg(F.count("*").alias("n"))
    beside = partners.join(own.select(F.col("player").alias("partner"), "g"), "partner").groupBy("player").agg(*(F.sum(F.when(F.col("g") == k, F.col("n")).otherwise(0)).alias(n) for k, n in (("M", "men"), ("F", "women"))))
    both = own.join(beside, "player", "left")
    told = F.when(F.expr("men > women"), "F").when(F.expr("women > men"), "M").otherwise("unknown")
    return both.select("player", F.coalesce("g", told).alias("gender"), F.when(F.col("g").isNotNull(), "own").when(F.expr("men <> women"), "partners").otherwise("none").alias("known"))


@query(f"""with {GAMES} select match_id, sign(sum(sign(margin))) winner, count(*) games from games group by match_id having sum(sign(margin)) <> 0""")
def match_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games folded into matches; drawn ones go."""
    return games(spark, sf_dir).groupBy("match_id").agg(F.sum(F.signum("margin")).alias("s"), F.count("*").alias("games")).where("s <> 0").select("match_id", F.signum("s").alias("winner"), "games")


@query("""with d as (select doc_id, 'lang ' || lang || ' source ' || source reason from documents) select regexp_replace(reason, '[0-9]+', '#', 'g') reason, count(*) n from d group by 1 order by n desc, reason limit 12""")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons with their numbers masked, the twelve most frequent: a top-k report."""
    reason = F.regexp_replace(F.concat(F.lit("lang "), F.col("lang"), F.lit(" source "), F.col("source")), "[0-9]+", "#")
    return table(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(12)


@query("select (count(*)) rows, cast(max(o_orderdate) as date) newest, count(distinct o_custkey) players from orders")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("rows"), F.max("o_orderdate").cast("date").alias("newest"), F.countDistinct("o_custkey").alias("players"))
