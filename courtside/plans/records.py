"""Raw match documents, made of `orders` in two dialects, through the parser to games, quarantine and checks."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.registry import query
from courtside.operators import records
from courtside.sources.storage import fresh_path, load_days, newest_by_key, quarantined, upserted, written_with_counts
from courtside.sources.tables import stored, table

_NAMES = {1: "One", 2: "Two", 3: "Three", 4: "Four", 5: "Five"}
_TITLES = ("Womens pairs, draw: main", "Mens pairs, draw: second", "Mixed pairs, draw: main", "Alone", "Mixed pairs, draw: third")
_ABBREVIATIONS = ("WD", "MDG", "MXD1", "DB", "mxd2")


def _pick(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at % 5 + 1).cast("int"))


def _packed(fields: dict):
    return F.struct(*(v.cast("string").alias(n) for n, v in fields.items()))


def _fields() -> dict:
    """A match record of an order, by its fields."""
    k = F.col("o_orderkey")
    target = F.when(k % 5 < 3, 11).when(k % 5 == 3, 15).otherwise(0)
    fields = {"matchUuid": F.concat(F.lit("M"), k), "matchStatus": F.when(k % 29 == 0, 3).otherwise(4), "matchCompletedType": F.when(k % 31 == 0, 6).otherwise(5), "didCancelMatch": k % 37 == 0}
    for n, slot in enumerate(("teamOnePlayerOne", "teamOnePlayerTwo", "teamTwoPlayerOne", "teamTwoPlayerTwo")):
        who = k * (n + 7) % 97 + 100 * n
        fields[f"{slot}Uuid"] = F.when((k % 41 == 0) & F.lit(n == 3), None).otherwise(F.concat(F.lit("P"), who))
        fields[f"{slot}Name"] = F.concat(F.lit("  Ann \t Lee  "), who)
    for i, name in _NAMES.items():
        played = F.lit(i <= 2) | (F.lit(i == 3) & (k % 3 == 0))
        high, low = target + (k + i) % 5 - 1 + F.when(target == 0, 12).otherwise(0), k * i % 12
        for one, side in ((True, "One"), (False, "Two")):
            score = F.when(((k + i) % 2 == 0) == F.lit(one), high).otherwise(low)
            fields[f"team{side}Game{name}Score"] = F.when(~played | (k % 82 == 0), None).otherwise(score)
        fields[f"scoreFormatGame{name}Max"] = target
    return fields


def _camel() -> dict:
    k = F.col("o_orderkey")
    return dict(_fields(), matchAbbreviation=_pick(_ABBREVIATIONS, k), matchupUuid=F.concat(F.lit("X"), F.floor(k / 8)), roundText=F.when(k % 3 == 0, "Finals"))


#: Stored bytes of orders whose documents a task writes or reads: some 15,000, each of about 2,000 bytes.
PART_BYTES = 256 << 10


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of orders in as many parts as their documents ask for: a key has few bytes, its document much to reckon, and a file may be one row group."""
    keys, parts = table(spark, sf_dir, "orders").select("o_orderkey"), stored(spark, f"{sf_dir}/orders.parquet") // PART_BYTES
    return keys.repartition(parts, "o_orderkey") if parts > 1 else keys


def raw_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body): an order is a match; even keys write camel case and a bare record, odd keys snake case and a list."""
    k = F.col("o_orderkey")
    snake = {records._snake(n): v for n, v in (_fields() | {"eventTitle": _pick(_TITLES, k), "roundText": F.when(k % 3 == 0, " Finals ")}).items()}
    even, odd = F.to_json(F.struct(_packed(_camel()).alias("data"))), F.to_json(F.struct(F.array(_packed(snake)).alias("data")))
    return _orders(spark, sf_dir).select(F.when(k % 2 == 0, even).otherwise(odd).alias("body"))


def fixture_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body): a fixture of up to four matches, nested in its document."""
    k = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").where(k % 2 == 0).select(F.concat(F.lit("X"), F.floor(k / 8)).alias("matchupUuid"), F.struct(k, _packed(dict(_camel(), isTieBreaker=k % 7 == 0)).alias("m")).alias("m"))
    nested = own.groupBy("matchupUuid").agg(F.sort_array(F.collect_list("m")).alias("matches"))  # eight keys a fixture
    return nested.select(F.to_json(F.struct("matchupUuid", F.col("matches.m").alias("matches"))).alias("body"))


def _matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return quarantined(records.matches(raw_bodies(spark, sf_dir)), F.col("reason"))


_TARGET = "case when k % 5 < 3 then 11 when k % 5 = 3 then 15 else 0 end"
_RAW = f"""
o as (select o_orderkey k, {_TARGET} target from orders),
mt as (select *, case when k % 2 = 0 then case k % 5 when 0 then 'womens' when 1 then 'mens' when 2 then 'mixed' when 4 then 'mixed' end else case k % 5 when 0 then 'womens' when 1 then 'mens' when 3 then null else 'mixed' end end context,
    k % 31 = 0 or k % 37 = 0 is_forfeit, k % 41 = 0 lacking, k % 82 <> 0 played from o),
ms as (select *, case when k % 29 = 0 then 'unfinished:3' when context is null then 'context' when lacking and not played then 'shell' when lacking then 'lost:t2_p2' when not played then 'unplayed' end reason from mt),
hl as (select *, target + (k + i) % 5 - 1 + case when target = 0 then 12 else 0 end high, k * i % 12 low from ms, (values (1), (2), (3)) t(i) where reason is null and (i <= 2 or k % 3 = 0)),
sc as (select *, case when (k + i) % 2 = 0 then high else low end s1, case when (k + i) % 2 = 0 then low else high end s2 from hl),
pl as (select *, greatest(s1, s2) top, abs(s1 - s2) lead from sc where s1 > 0 or s2 > 0),
gm as (select *, case when is_forfeit then null when target > 0 and top < target then 'short:' || s1 || '-' || s2 || '/' || target when target = 0 and (top < 11 or lead < 2) then 'unlikely:' || s1 || '-' || s2 end dropped,
    case when is_forfeit then null when target > 0 and top = target and lead < 2 then 'narrow:' || lead when target > 0 and top > target and lead <> 2 then 'overrun:' || s1 || '-' || s2 || '/' || target when target = 0 and top > 15 then 'long:' || top end flagged from pl)
"""


@query(f"""with {_RAW} select 'm' || k || ':g' || i game_id, 'm' || k match_id, context, case when k % 2 = 1 and k % 5 = 1 then case when k % 3 = 0 then 'second — Finals' else 'second' end when k % 2 = 1 and k % 5 = 4 then case when k % 3 = 0 then 'third — Finals' else 'third' end when k % 3 = 0 then 'Finals' else '' end stage,
    'sideout_' || target scoring_format, 'p' || (k * 7 % 97) t1_p1, 'p' || (k * 8 % 97 + 100) t1_p2, 'p' || (k * 9 % 97 + 200) t2_p1, 'p' || (k * 10 % 97 + 300) t2_p2, 'Ann Lee ' || (k * 7 % 97) t1_p1_name,
    s1, s2, s1 - s2 margin, i game_number, is_forfeit, flagged is not null flag from gm where dropped is null""", s1="int", s2="int", margin="int", game_number="int")
def raw_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games that can be used, from documents of both dialects."""
    good, _ = _matches(spark, sf_dir)
    games = records.games_of(good).where("action <> 'drop'")
    return games.select("game_id", "match_id", "context", "stage", records.format_label(F.col("is_rally"), F.col("target")).alias("scoring_format"), "t1_p1", "t1_p2", "t2_p1", "t2_p2", "t1_p1_name", "s1", "s2", "margin", "game_number", "is_forfeit", (F.col("action") == "flag").alias("flag"))


@query(f"""with {_RAW} select 'm' || k match_id, cast(null as int) game, 'drop' "action", reason from ms where reason is not null
union all select 'm' || k, i, case when dropped is not null then 'drop' else 'flag' end, coalesce(dropped, flagged) from gm where coalesce(dropped, flagged) is not null""")
def raw_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that was dropped or flagged, with its reason: matches and games."""
    return records.quarantine_of(records.matches(raw_bodies(spark, sf_dir)))


@query(f"with {_RAW} select 'x' || (k // 8) fixture, count(*) n from gm where k % 2 = 0 and dropped is null group by all having count(*) <> 4")
def fixture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures that have not four games."""
    good, _ = _matches(spark, sf_dir)
    return records.games_of(good).where("action <> 'drop' and fixture is not null").groupBy("fixture").agg(F.count("*").alias("n")).where("n <> 4")


@query(f"""with {_RAW}, seen as (select k * 7 % 97 p, context, k from ms where context in ('mens', 'womens') and k % 29 <> 0 union all select k * 8 % 97 + 100, context, k from ms where context in ('mens', 'womens') and k % 29 <> 0
    union all select k * 9 % 97 + 200, context, k from ms where context in ('mens', 'womens') and k % 29 <> 0 union all select k * 10 % 97 + 300, context, k from ms where context in ('mens', 'womens') and k % 29 <> 0 and not lacking),
gd as (select p, case arg_min(context, k) when 'mens' then 'M' else 'F' end gender from seen group by p)
select 'm' || k || ':g' || i game_id from gm left join gd a on a.p = k * 7 % 97 left join gd b on b.p = k * 8 % 97 + 100 left join gd c on c.p = k * 9 % 97 + 200 left join gd d on d.p = k * 10 % 97 + 300
where context = 'mixed' and dropped is null and (coalesce(a.gender = b.gender, false) or coalesce(c.gender = d.gender, false))""")
def mixed_same_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed games with a pair of one gender, genders being those of the first single-gender match a player was seen in."""
    every = records.matches(raw_bodies(spark, sf_dir))
    slots = ["t1_p1", "t1_p2", "t2_p1", "t2_p2"]
    seen = every.where("context in ('mens', 'womens')").where(F.col("status") == records.COMPLETED).select(F.explode(F.array(*slots)).alias("p"), "context", F.substring("match_id", 2, 20).cast("long").alias("at")).where("p <> ''")
    gender = seen.groupBy("p").agg(F.when(F.min_by("context", "at") == "mens", "M").otherwise("F").alias("gender"))
    games = records.games_of(every.where("reason is null and context = 'mixed'")).where("action <> 'drop'").select("game_id", *slots)
    for s in slots:
        games = games.join(gender.select(F.col("p").alias(s), F.col("gender").alias(f"{s}_is")), s, "left")
    return games.where("t1_p1_is = t1_p2_is or t2_p1_is = t2_p2_is").select("game_id")


_TITLED = "case p_partkey % 5 when 0 then 'Open ' || p_name when 1 then 'Junior ' || p_name when 2 then 'Senior Pro ' || p_name when 3 then 'Pro Main ' || p_name else p_name end"


@query(f"""select p_partkey, not regexp_matches(t, '(?i)\\bjunior|\\bsenior') and (contains(p_type, 'BRASS') or regexp_matches(t, '\\bOpen\\b')) tour_event, p_partkey % 4 = 0 and not contains(lower(t), 'junior') league,
contains(lower(t), 'pro') and not contains(lower(t), 'senior') and not contains(lower(t), 'junior') pro from (select *, {_TITLED} t from part)""")
def event_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events, leagues and groups are the tours': by titles, contacts and slugs."""
    titled = table(spark, sf_dir, "part").withColumn("t", F.expr(_TITLED))
    slug = F.when(F.col("p_partkey") % 4 == 0, "own-league").otherwise("other")
    tour = records.is_tour_event(F.col("t"), [F.col("p_type"), F.lit(None).cast("string")], r"\bOpen\b", r"(?i)\bjunior|\bsenior", "BRASS")
    return titled.select("p_partkey", tour.alias("tour_event"), records.is_league(slug, F.col("t"), "own-league").alias("league"), records.is_pro_group(F.col("t")).alias("pro"))


@query("""select o_orderkey, o_orderkey % 3 = 0 is_uuid, o_orderkey % 2 = 0 is_date from orders""")
def id_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and dates by their form."""
    k = F.col("o_orderkey")
    hexed = F.lpad(F.hex(k), 32, "0")
    cut = lambda a, n: F.substring(hexed, a, n)
    uuid = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    text = F.when(k % 3 == 0, uuid).otherwise(F.concat(uuid, F.lit("x")))
    day = F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", records.is_uuid(text).alias("is_uuid"), records.is_date(day).alias("is_date"))


@query("""with r as (select o_custkey, o_orderkey, o_orderdate, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from orders where o_orderkey % 2 = 1 and o_custkey is not null)
select c_custkey, coalesce(o_totalprice, c_acctbal) v, o_custkey is not null renewed from customer left join (select * from r where n = 1) on c_custkey = o_custkey""")
def upserted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge by key: customers' values with the newest order in place of the old one; new rows may repeat a key."""
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("v"), F.lit(False).alias("renewed"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(0).cast("long").alias("n"))
    own = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 1").join(old.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    new = own.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("v"), F.lit(True).alias("renewed"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("n"))
    return upserted(old, new, ["c_custkey"], [F.desc("at"), F.desc("n")]).select("c_custkey", "v", "renewed")


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n = 1")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_by_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type")


@query("""with d as (select cast(ts as date) d from events), m as (select max(d) m from d), t as (select cast(ts as date) d, count(*) n from events group by all) select d, n, d >= m - 3 volatile from t, m""")
def volatile_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that a later load would fetch and overwrite again: the last three before the newest; older ones are final."""
    t = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    newest = F.max("d").over(Window.partitionBy(F.lit(0)))  # a row a day
    return t.withColumn("volatile", F.col("d") >= F.date_sub(newest, 3))


@query("""select 'orders' what, count(*) n, count(*) - count(distinct o_orderkey) repeated, count_if(o_orderkey is null) missing from orders union all select 'customer', count(*), count(*) - count(distinct c_custkey), count_if(c_custkey is null) from customer
union all select 'lineitem', count(*), count(*) - count(distinct l_orderkey || ':' || l_linenumber), count_if(l_orderkey is null) from lineitem""")
def key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run's tables, and whether their keys are keys."""
    keys = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
    parts = [table(spark, sf_dir, t).agg(F.lit(t).alias("what"), F.count("*").alias("n"), (F.count("*") - F.count_distinct(*map(F.col, k))).alias("repeated"), F.count_if(F.col(k[0]).isNull()).alias("missing")) for t, k in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""with s as (select user_id // 4 m, cast(k % 12 as int) a, cast(k // 12 % 3 as int) b, event_id from (select *, cast(json_extract_string(props, '$.k') as int) k from events)),
l as (select m, list(struct_pack(a := a, b := b) order by event_id desc)[1:5] t from s group by m)
select m, len(t) n, coalesce(list_max([i for i in range(1, len(t) + 1) if t[i].a > 0 or t[i].b > 0]), 0) trimmed, array_to_string([x.a || '-' || x.b for x in t[1:coalesce(list_max([i for i in range(1, len(t) + 1) if t[i].a > 0 or t[i].b > 0]), 0)]], '|') joined from l""", m="bigint", n="int", trimmed="int")
def trimmed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live match's score pairs, cut after the last one that isn't zero, and joined to a string."""
    k = F.get_json_object("props", "$.k").cast("int")
    s = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 4).cast("long").alias("m"), (k % 12).alias("a"), (F.floor(k / 12) % 3).cast("int").alias("b"), "event_id")
    w = Window.partitionBy("m").orderBy(F.desc("event_id"))
    last = s.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("m").agg(F.array_sort(F.collect_list(F.struct("r", "a", "b"))).alias("t"))
    cut = F.coalesce(F.array_max(F.transform(F.filter("t", lambda x: (x.a > 0) | (x.b > 0)), lambda x: x.r)), F.lit(0))
    out = last.withColumn("trimmed", cut)
    return out.select("m", F.size("t").alias("n"), "trimmed", F.array_join(F.transform(F.slice("t", 1, F.greatest("trimmed", F.lit(0))), lambda x: F.concat_ws("-", x.a, x.b)), "|").alias("joined"))


@query("""with e as (select *, cast(ts as date) d, cast(json_extract_string(props, '$.k') as int) k from events), m as (select max(d) m from e), t as (select e.* from e, m where d >= m - 3 or (k % 11 <> 0))
select d, count(*) n, round(sum("value"), 4) "value", count_if(k % 11 = 0) late from t group by d""")
def corrected_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by days, loaded before some rows had come, then loaded again with all: the last days are put right, the final ones stay as they were."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), "event_id", "value", k.alias("k"))
    path = fresh_path(spark, "by-day")
    load_days(path, e.where("k % 11 <> 0 or k is null"), "d")
    load_days(path, e, "d")
    load_days(path, e, "d")  # once more, as after a run whose end was not seen
    return spark.read.parquet(path).groupBy("d").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"), F.count_if(F.col("k") % 11 == 0).alias("late"))


@query("""select 'orders' what, count(*) n, count_if(o_orderkey is null) missing from orders union all select 'customer', count(*), count_if(c_custkey is null) from customer union all select 'lineitem', count(*), count_if(l_orderkey is null) from lineitem""")
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run wrote, counted while it was written."""
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "lineitem": "l_orderkey"}
    return written_with_counts({t: (table(spark, sf_dir, t), k) for t, k in keys.items()}, fresh_path(spark, "run"))


_SLOTTED = """sl as (select 'x' || (k // 8) fixture, k, case k % 5 when 0 then 'WD' when 1 then 'MD' when 2 then 'MXD1' when 4 then 'MXD2' end slot from (select o_orderkey k from orders where o_orderkey % 2 = 0 and o_orderkey % 7 <> 0 and o_orderkey % 41 <> 0)),
ln as (select fixture, slot, max(k) k from sl where slot is not null group by all)"""


@query(f"with {_SLOTTED} select fixture, slot, 'p' || (k * 7 % 97) one_1, 'p' || (k * 8 % 97 + 100) one_2, 'p' || (k * 9 % 97 + 200) two_1, 'p' || (k * 10 % 97 + 300) two_2 from ln")
def lineup_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who played which slot of a fixture, out of the matches nested in its document."""
    found = records.lineups(fixture_bodies(spark, sf_dir))
    return found.select("fixture", "slot", *(F.col(c)[i].alias(f"{c}_{i + 1}") for c in ("one", "two") for i in (0, 1)))


@query(f"""with {_SLOTTED}, w as (select fixture, min(case when k * 9 % 97 + 200 = 200 + f then 2 end) side from (select *, cast(substr(fixture, 2) as bigint) % 97 f from ln) group by fixture)
select fixture, slot, 'p' || (k * 9 % 97 + 200) own_1, 'p' || (k * 7 % 97) other_1 from ln join w using (fixture) where side = 2""")
def turned_lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures seen from the side of a given player, all their slots turned together."""
    found = records.lineups(fixture_bodies(spark, sf_dir))
    asked = found.withColumn("asked", F.concat(F.lit("p"), (200 + F.substring("fixture", 2, 20).cast("long") % 97).cast("string")))
    return records.turned(asked, "asked").select("fixture", "slot", F.col("own")[0].alias("own_1"), F.col("other")[0].alias("other_1"))
