"""Registered queries of pages, pictures, checks, votes, space weather and the sky; importing it adds them to the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exchange, mac, planets
from ..operators import browse, catalogue, checks, puzzles, ranking, reads, reuse, search, voting
from ..sources import feed_source, space, work
from ..sources.tables import entries, read, votes
from ..streaming import budgets
from .registry import _BAG, _ENTRIES, _LINKS, _P, _VOTES, WEIGHTS, W04_words, W05_resources, X22_page_links, archive_years, query, stored_index

# -- words and links ----------------------------------------------------------------------------------------------


@query(_BAG + "select word, sum(n)::bigint as total, count(*) as entries, min(date_id) as first_id, max(date_id) as last_id from bag where word = 'the' group by word")
def A17_word_totals(spark, sf_dir):
    return browse.word_totals(catalogue.entry_words(entries(spark, sf_dir)), " The ")


@query(_BAG + "select year::int as year, sum(n)::bigint as total, count(*) as entries from bag where word = 'the' group by year")
def A17_word_years(spark, sf_dir):
    e = entries(spark, sf_dir)
    return browse.word_years(catalogue.entry_words(e), e, "the")


@query(_BAG + "select date_id, title, n from bag join entries using (date_id) where word = 'the' order by n desc, date_id desc limit 10")
def A17_word_top(spark, sf_dir):
    e = entries(spark, sf_dir)
    return browse.word_top(catalogue.entry_words(e), e, "the")


@query(_BAG + "select word, total, entries from catalogue where contains(word, 'an') and total between 3 and 400")
def P06_word_filters(spark, sf_dir):
    return browse.ordered_words(W04_words(spark, sf_dir), "entries", pattern="an", min_total=3, max_total=400)


@query(_LINKS + "select count(*) as links, count(distinct host) as hosts, sum(refs)::bigint as refs, count(*) filter (where entries = 1) as used_once from resources")
def A06_link_summary(spark, sf_dir):
    return browse.link_summary(W05_resources(spark, sf_dir))


@query(_LINKS + """select key, host, refs, entries, label from resources r where refs >= 2 and (contains(lower(key), 'a') or contains(lower(label), 'e')
    or exists (select 1 from links l where l.key = r.key and contains(lower(l.anchor), 'a')))""")
def P04_link_filters(spark, sf_dir):
    kept = browse.link_filter(W05_resources(spark, sf_dir), X22_page_links(spark, sf_dir), min_refs=2, query=" A ")
    return kept.select("key", "host", "refs", "entries", "label")


@query(_LINKS + "select key, label from resources order by label is null, lower(label) desc, key limit 30")
def L03_links_by_label(spark, sf_dir):
    return browse.ordered_links(W05_resources(spark, sf_dir), "label").limit(30).select("key", "label")


_MOST = "(select key from resources order by refs desc, entries desc, key limit 1)"


def _most_linked(spark, sf_dir) -> str:
    row = browse.ordered_links(W05_resources(spark, sf_dir)).select("key").first()
    return row[0] if row else ""


@query(_LINKS + f"select page_id, key, anchor, n from links where key = {_MOST} order by page_id desc limit 30")
def Z01_link_references(spark, sf_dir):
    return browse.link_references(X22_page_links(spark, sf_dir), _most_linked(spark, sf_dir)).select("page_id", "key", "anchor", "n")


@query(_LINKS + f"select anchor, count(*) as entries from links where key = {_MOST} and anchor <> '' group by anchor order by count(*) desc, length(anchor), anchor limit 12")
def A13_link_anchors(spark, sf_dir):
    return browse.link_anchors(X22_page_links(spark, sf_dir), _most_linked(spark, sf_dir))


@query(_ENTRIES + "select date_id, date from entries order by date_id desc limit 1")
def S06_latest(spark, sf_dir):
    return browse.latest(entries(spark, sf_dir).select("date_id", "date"))


@query("select c_custkey as date_id, count(o_orderkey) as media, md5(coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey), '')) as listed from customer left join orders on o_custkey = c_custkey group by 1")
def S05_entry_media(spark, sf_dir):
    media = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("date_id"), F.col("o_orderkey").alias("idx"), F.lit("image_jpg").alias("kind"), F.lit("").alias("url"))
    found = browse.with_media(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("date_id")), media)
    listed = F.array_join(F.transform("media", lambda m: m["idx"].cast("string")), ",")
    return found.select("date_id", F.size("media").cast("long").alias("media"), F.md5(listed).alias("listed"))


# -- pictures -----------------------------------------------------------------------------------------------------

_PICTURES = """with recursive p as (select p_partkey as date_id, p_type as title, case when p_partkey % 70 = 0 then 'u' || (p_partkey // 700) else '' end as media_url,
        case p_partkey % 4 when 0 then 'image_jpg' when 1 then 'youtube' else 'other' end as kind, case when p_size > 10 then p_name end as thumb_path,
        xor(('0x' || substr(md5((p_partkey // 10)::varchar), 1, 15))::bigint, 1::bigint << (3 * (p_partkey % 10))::int) as print from part),
    pairs as (select x.date_id as a, y.date_id as b from p x join p y on x.date_id <> y.date_id and ((x.media_url <> '' and x.media_url = y.media_url)
        or (bit_count(xor(x.print, y.print)) <= 8 and bit_count(x.print) between 4 and 60 and bit_count(y.print) between 4 and 60))),
    reach as (select distinct a as date_id, a as other from pairs union select reach.date_id, pairs.b from reach join pairs on pairs.a = reach.other),
    g as (select date_id, min(other) as picture_group from reach group by date_id),
    e as (select p.*, picture_group from p left join g using (date_id)) """


def _pictures(spark, sf_dir):
    """Parts as entries: ten neighbours share a print but for a bit each, every seventieth an address."""
    key = F.col("p_partkey")
    base = F.conv(F.substring(F.md5(F.expr("cast(p_partkey div 10 as string)").cast("binary")), 1, 15), 16, 10).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (3 * F.pmod(key, F.lit(10))).cast("int"))
    return read(spark, sf_dir, "part").select(
        key.alias("date_id"), F.col("p_type").alias("title"), F.when(key % 70 == 0, F.concat(F.lit("u"), F.expr("cast(p_partkey div 700 as string)"))).otherwise("").alias("media_url"),
        F.when(key % 4 == 0, "image_jpg").when(key % 4 == 1, "youtube").otherwise("other").alias("kind"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("thumb_path"),
        F.when(F.lit(True), base.bitwiseXOR(bit)).alias("print"), (key % 9).alias("parser_version"), F.when(F.col("p_size") > 20, F.col("p_size")).alias("thumb_width"),
    )


def _grouped(spark, sf_dir):
    """Entries with their picture groups, found once and written."""
    e = _pictures(spark, sf_dir)
    return reuse.regrouped(e, work.kept(reuse.picture_groups(e, checkpoint=work.kept)))


@query(_PICTURES + "select date_id, picture_group from g")
def H04_picture_groups(spark, sf_dir):
    return _grouped(spark, sf_dir).where("picture_group is not null").select("date_id", "picture_group")


@query(_PICTURES + "select x.date_id as a, min(y.date_id) as b, count(*) as near from p x join p y on x.date_id <> y.date_id and bit_count(xor(x.print, y.print)) <= 8 and bit_count(x.print) between 4 and 60 and bit_count(y.print) between 4 and 60 group by 1")
def H03_near_entries(spark, sf_dir):
    from ..operators.pictures import near_pairs

    held = _pictures(spark, sf_dir).select("date_id", "print")
    near = near_pairs(held)
    both = near.select("a", "b").union(near.select("b", "a"))
    met = both.join(held.withColumnsRenamed({"date_id": "x", "print": "a"}), "a").join(held.withColumnsRenamed({"date_id": "y", "print": "b"}), "b")
    return met.groupBy(F.col("x").alias("a")).agg(F.min("y").alias("b"), F.count("*").alias("near"))


_LISTED = _PICTURES + """, l as (select picture_group, count(*) as shown, min(date_id) as first_id, max(date_id) as last_id, count(distinct title) as titles, max(date_id) - min(date_id) as span_days from e where picture_group is not null group by 1)
    select l.*, p.title, p.media_url from l join p on p.date_id = picture_group """


@query(_LISTED)
def H06_pictures(spark, sf_dir):
    return reuse.pictures(_grouped(spark, sf_dir))


@query(_LISTED + "order by span_days desc, picture_group limit 20")
def L05_pictures_by_span(spark, sf_dir):
    return reuse.ordered(H06_pictures(spark, sf_dir), "span").limit(20)


@query(_LISTED + "where shown >= 5 and titles > 1 and exists (select 1 from e r where r.picture_group = l.picture_group and contains(lower(r.title), 'a'))")
def P07_picture_filters(spark, sf_dir):
    e = _grouped(spark, sf_dir)
    return reuse.filtered(reuse.pictures(e), e, query="a", min_shown=5, retitled=True)


@query(_PICTURES + """select count(distinct picture_group) as pictures, count(picture_group) as entries, count(print) as hashed,
    (select picture_group from e where picture_group is not null group by 1 order by count(*) desc, 1 limit 1) as most_shown,
    (select count(*) from e where picture_group is not null group by picture_group order by count(*) desc limit 1) as most_shown_times from e""")
def A15_picture_summary(spark, sf_dir):
    return reuse.summary(_grouped(spark, sf_dir))


@query(_PICTURES + "select min(date_id) as date_id from e where thumb_path is not null and kind in ('image_jpg', 'youtube') and date_id < 1500 group by coalesce(picture_group, date_id)")
def A16_picture_pool(spark, sf_dir):
    return reuse.pool(_grouped(spark, sf_dir), ("image_jpg", "youtube"), before=1500)


@query(_PICTURES + """select x.date_id, case when x.picture_group is null then x.date_id::varchar else (select string_agg(y.date_id::varchar, ',' order by y.date_id) from e y where y.picture_group = x.picture_group) end as runs
    from e x where x.date_id <= 40""")
def H05_group_dates(spark, sf_dir):
    e = _grouped(spark, sf_dir)
    found = reuse.group_dates(e, e.where("date_id <= 40").select("date_id"))
    return found.select("date_id", F.array_join(F.transform("runs", lambda d: d.cast("string")), ",").alias("runs"))


@query(_PICTURES + "select picture_group, count(*) as shown from e where picture_group is not null group by 1 order by 2 desc, 1 limit 20")
def Z06_largest_groups(spark, sf_dir):
    return reuse.largest(_grouped(spark, sf_dir))


@query(_PICTURES + "select date_id from p where thumb_path is null and kind in ('image_jpg', 'youtube')")
def P10_missing_thumbs(spark, sf_dir):
    return browse.work_list(_pictures(spark, sf_dir), "missing").select("date_id")


@query("select p_partkey as date_id from part where p_size > 10 and p_size <= 20")
def P09_unmeasured_thumbs(spark, sf_dir):
    return browse.work_list(_pictures(spark, sf_dir), "unmeasured").select("date_id")


@query("select p_partkey as date_id from part where p_partkey % 9 < 4")
def P11_stale(spark, sf_dir):
    return browse.stale(_pictures(spark, sf_dir), 4).select("date_id")


@query("select count(*) as entries, round(100 * count(*) / 4000.0, 6) as coverage_percent, count(*) filter (where p_partkey % 9 < 4) as stale, count(*) filter (where p_size > 10) as thumbs, count(*) as hashed from part")
def A22_status(spark, sf_dir):
    return checks.status(_pictures(spark, sf_dir), 4000, 4)


# -- checks -------------------------------------------------------------------------------------------------------

_S = r"[\t-\r \x{85}\p{Z}]"


def _text_sql(field: str, c: str) -> str:
    rules = {"leading_whitespace": f"^{_S}", "trailing_whitespace": rf"{_S}\z", "multi_whitespace": f"{_S}{_S}", "contains_html": r"<[\t-\r ]*/?[a-zA-Z]"}
    return ", ".join([f"case when {c} = '' then '{field}:empty_field' end", *[f"case when regexp_matches({c}, '{p}') then '{field}:{n}' end" for n, p in rules.items()]])


def _far_sql(c: str) -> str:
    return f"len(list_filter(regexp_extract_all({c}, 'href=\"([^\"]*)\"', 1), lambda a: not regexp_matches(a, '^(https?://|mailto:)'))) > 0"


_CHECKED = _ENTRIES + f""", c as (select date_id, title, text, case when kind = 'image' then '' when kind = 'video' then host || '  x' else '<b ' || host end as credit, kind from entries),
    i as (select date_id, list_filter([{_text_sql("title", "title")},
        case when regexp_matches(title, '(?i)^tomorrow[''’]s{_S}+picture\\b') then 'title:title_is_teaser_label' end,
        case when regexp_matches(title, '\\n(?s:.)') then 'title:title_multiline' end, case when length(title) > 200 then 'title:title_suspiciously_long' end,
        {_text_sql("explanation", "text")}, case when text <> '' and length(text) < 80 then 'explanation:explanation_suspiciously_short' end,
        case when {_far_sql("text")} then 'explanation:non_absolute_link' end, case when kind = 'image' then 'credit:credit_missing' end]
        || case when kind = 'image' then [] else [{_text_sql("credit", "credit")}, case when kind = 'video' then 'credit:non_absolute_link' end, case when kind = 'other' then 'credit:credit_role_suspicious' end] end
        || [case when kind = 'other' then 'media:unknown_media_kind' end], lambda x: x is not null) as issues from c) """


def _checked(spark, sf_dir):
    e = entries(spark, sf_dir)
    said = F.when(F.col("kind") == "video", F.concat("host", F.lit("  x"))).otherwise(F.concat(F.lit("<b "), "host"))
    role = F.when(F.col("kind") == "video", "Image and text by").otherwise("Image and text of one two three")
    html = F.when(F.col("kind") == "video", '<a href="../x">').otherwise('<a href="https://x">')
    one = F.array(F.struct(role.alias("role"), said.alias("text"), html.alias("html")))
    none = F.array().cast("array<struct<role:string,text:string,html:string>>")
    credits = F.when(F.col("kind") == "image", none).otherwise(one)
    return e.select("date_id", checks.issues(F.col("title"), F.col("text"), F.col("text"), credits, F.col("kind"), F.lit(None).cast("boolean")).alias("issues"))


@query(_CHECKED + "select date_id, array_to_string(list_sort(issues), ' ') as issues from i")
def X35_issues(spark, sf_dir):
    told = F.transform("issues", lambda i: F.concat_ws(":", i["field"], i["warning"]))
    return _checked(spark, sf_dir).select("date_id", F.array_join(F.array_sort(told), " ").alias("issues"))


@query(_CHECKED + ", f as (select date_id, split_part(unnest(issues), ':', 2) as warning from i) select warning, count(*) as issues, count(distinct date_id) as entries from f group by 1")
def A21_quality_report(spark, sf_dir):
    return checks.report(_checked(spark, sf_dir))


# -- votes --------------------------------------------------------------------------------------------------------

_VOTERS = _VOTES + ", voters as (select distinct user_id as voter, 'c' || (user_id % 50) as cohort, user_id % 11 = 0 as blocked, 1.0 + user_id % 3 as weight from events) "


def _voters(spark, sf_dir):
    u = F.col("user_id")
    held = read(spark, sf_dir, "events").select("user_id").distinct()
    return held.select(u.alias("voter"), F.concat(F.lit("c"), (u % 50).cast("string")).alias("cohort"), (u % 11 == 0).alias("blocked"), (1.0 + u % 3).alias("weight"))


@query(_VOTERS + "select vote_id, voter, weight::double as weight from votes join voters using (voter) where not blocked")
def J07_counted_votes(spark, sf_dir):
    return voting.counted_votes(votes(spark, sf_dir), _voters(spark, sf_dir)).select("vote_id", "voter", "weight")


@query(_VOTERS + "select cohort, count(*) as used from votes join voters using (voter) where voted_at >= (select max(ts) from events) - interval 5 day group by 1")
def J08_cohort_use(spark, sf_dir):
    last = read(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return voting.cohort_use(votes(spark, sf_dir), _voters(spark, sf_dir), F.lit(last) - F.expr("interval 5 days"))


@query(_VOTERS + """select category, count(*) as votes, (select count(*) from voters where not blocked) as voters, max(fitted_at) as fitted_at
    from (select vote_id % 3 as category from votes) left join (select event_id % 3 as f, max(ts) as fitted_at from events where event_type = 'signup' group by 1) on f = category group by 1""")
def A18_tally(spark, sf_dir):
    cast = votes(spark, sf_dir).withColumn("category", F.col("vote_id") % 3)
    fits = read(spark, sf_dir, "events").where("event_type = 'signup'").select((F.col("event_id") % 3).alias("category"), F.col("ts").alias("fitted_at"))
    return voting.tally(cast, _voters(spark, sf_dir), fits)


@query("""select coalesce(c_custkey, s_suppkey) as picture, coalesce(c_acctbal, s_acctbal) as score, case when s_suppkey % 3 = 0 then s_acctbal end as prior_score
    from supplier full join (select * from customer where c_custkey % 2 = 0) on c_custkey = s_suppkey where c_custkey is not null or s_suppkey % 3 = 0""")
def W15_saved_fit(spark, sf_dir):
    key, own = F.col("s_suppkey"), F.col("s_acctbal")
    nothing = [F.lit(1.0).alias("stderr"), F.lit(0).cast("long").alias("comparisons")]
    stored = read(spark, sf_dir, "supplier").select(key.alias("picture"), own.alias("score"), *nothing, F.when(key % 3 == 0, own).alias("prior_score"), F.lit(1.0).alias("prior_stderr"))
    fit = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("picture"), F.col("c_acctbal").alias("score"), *nothing)
    return voting.saved(stored, fit).select("picture", "score", "prior_score")


@query("select s_suppkey as picture, s_acctbal as score, least(greatest(s_acctbal / 100, 0), 50) as ess, 1 / sqrt(nullif(least(greatest(s_acctbal / 100, 0), 50) * 0.25, 0)) as stderr from supplier")
def Z11_anchors(spark, sf_dir):
    return voting.anchors(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("picture"), F.col("s_acctbal").alias("score"), (F.col("s_acctbal") / 100).alias("ess")))


@query("select floor(s_acctbal / 0.25)::bigint as band, count(*) as pictures, count(*)::double as doubt from supplier group by 1")
def R06_bands(spark, sf_dir):
    return voting.bands(read(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("score"), F.lit(1.0).alias("stderr")))


# -- space weather ------------------------------------------------------------------------------------------------

_ALERTS = """with k as (select *, case event_type when 'view' then 'ALERT' when 'purchase' then 'WATCH' when 'error' then 'CANCEL WARNING' else 'NOTHING' end as word from events),
    a as (select 'P' || (user_id % 5) || '-' || epoch(date_trunc('second', ts))::bigint as id, case event_type when 'view' then 'alert' when 'purchase' then 'watch' else 'warning' end as notice,
        'Level ' || event_id as headline, 'G' || (user_id % 6) as scale, date_trunc('second', ts) as issued_at, timestamp '2024-01-05 06:00:00' as valid_until, event_id from k where word <> 'NOTHING') """


def _alerts(spark, sf_dir):
    word = F.when(F.col("event_type") == "view", "ALERT").when(F.col("event_type") == "purchase", "WATCH").when(F.col("event_type") == "error", "CANCEL WARNING").otherwise("NOTHING")
    message = F.concat(
        F.lit("Space Weather Message Code: X\r\n "), word, F.lit(": Level "), F.col("event_id").cast("string"), F.lit(" \r\nValid To: 2024 Jan 01 0000 UTC\r\nNow Valid Until: 2024 Jan 05 0600 UTC\r\nNOAA Scale: G"),
        (F.col("user_id") % 6).cast("string"), F.lit(" - Minor"),
    )
    raw = read(spark, sf_dir, "events").select(F.concat(F.lit("P"), (F.col("user_id") % 5).cast("string")).alias("product_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("issue_datetime"), message.alias("message"))
    return space.alerts(raw, None)


@query(_ALERTS + "select notice, headline, scale || ' - Minor' as scale, valid_until, issued_at from a")
def S16_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir).select("notice", "headline", "scale", "valid_until", "issued_at")


@query(_ALERTS + "select headline from a where valid_until >= timestamp '2024-01-05 05:00:00' and notice in ('alert', 'warning')")
def P13_current_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir).where(space.current(F.lit("2024-01-05 05:00:00").cast("timestamp"))).select("headline")


@query(_ALERTS + "select 'aurora' as topic, upper(notice[1]) || notice[2:] || ': ' || headline as title from a")
def T06_weather_notices(spark, sf_dir):
    return space.weather_notices(_alerts(spark, sf_dir), F.lit("2024-01-05 05:00:00").cast("timestamp"), "aurora", "weather").select("topic", "title")


@query("select event_id, case when value >= 8 then 'Severe geomagnetic storm' when value >= 7 then 'Strong geomagnetic storm' when value >= 6 then 'Moderate geomagnetic storm' when value >= 5 then 'Minor geomagnetic storm' when value >= 4 then 'Unsettled' else 'Quiet' end as label, value >= 5 as storm from events")
def P14_storm_labels(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", space.storm_label(F.col("value")).alias("label"), space.is_storm(F.col("value")).alias("storm"))


@query("select event_id as id, ts as net from events where ts < (select max(ts) from events) - interval 1 day order by ts desc, event_id limit 25")
def P12_recent_launches(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("net"))
    last, first = e.agg(F.max("net"), F.min("net")).first()
    return space.recent_launches(e, F.lit(first), F.lit(last) - F.expr("interval 1 day"), 25)


# -- texts --------------------------------------------------------------------------------------------------------


@query(_ENTRIES + f"select date_id, md5(text) as joined, len(regexp_extract_all(text, '{_P}'))::bigint as words from entries")
def X06_spans(spark, sf_dir):
    found = exchange.spans(F.col("text"))
    words = F.size(F.filter("found", lambda p: p["kind"] == "word")).cast("long")
    return entries(spark, sf_dir).select("date_id", found.alias("found")).select("date_id", F.md5(F.array_join(F.transform("found", lambda p: p["text"]), "")).alias("joined"), words.alias("words"))


@query("select doc_id as date_id, case doc_id % 3 when 0 then 'v' || doc_id when 1 then doc_id::varchar end as video from documents")
def X21_video_ids(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    kind = F.when(F.col("doc_id") % 3 == 0, "youtube").when(F.col("doc_id") % 3 == 1, "vimeo").otherwise("image_jpg")
    url = F.when(kind == "youtube", F.concat(F.lit("https://www.youtube.com/embed/v"), i, F.lit("?rel=0"))).otherwise(F.concat(F.lit("https://vimeo.com/moogaloop.swf?x=1&clip_id="), i))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("date_id"), exchange.video_id(kind, url).alias("video"))


@query("select doc_id as date_id, doc_id as back, 6 as letters from documents")
def X29_codes(spark, sf_dir):
    coded = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("date_id"), exchange.code_of(F.col("doc_id"), "picture").alias("code"))
    return coded.select("date_id", exchange.number_of(F.col("code"), "picture").alias("back"), F.length("code").alias("letters"))


@query()
def X25_turn_differences(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("old"))
    both = turns.join(before, ["conv_id", "turn"]).withColumn("diff", exchange.diff_words("old", "text"))
    return both.select("conv_id", "turn", *[exchange.count_words(F.col("diff"), k).alias(k) for k in ("same", "added", "removed")])


@query(_ENTRIES + "select date_id from entries where contains(lower(text), 'the') and regexp_matches(strip_accents(text), '(?i)(^|[^\\p{L}\\p{N}\\p{M}])the($|[^\\p{L}\\p{N}\\p{M}])') order by date_id desc limit 20")
def F09_newest_matches(spark, sf_dir):
    return stored_index(spark, sf_dir).search('"the"', WEIGHTS).where("hits_text").orderBy(F.desc("date_id")).limit(20).select("date_id")


@query()
def F10_snippets(spark, sf_dir):
    """The matches come from the index, only their texts are read."""
    wanted = '"of the" OR "scum" OR video'
    return search.snippets(entries(spark, sf_dir), wanted, "text", 12, found=stored_index(spark, sf_dir).search(wanted, WEIGHTS))


# -- sky ----------------------------------------------------------------------------------------------------------


@query()
def K08_planets(spark, sf_dir):
    return planets.planets(entries(spark, sf_dir).select(F.col("date").cast("timestamp").alias("at")).distinct())


def _new_years(spark, sf_dir):
    return archive_years(spark, sf_dir).select(F.make_timestamp("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("at"))


@query()
def K09_milestones(spark, sf_dir):
    return planets.milestones(_new_years(spark, sf_dir))


@query()
def K10_shower_peaks(spark, sf_dir):
    return planets.shower_peaks(_new_years(spark, sf_dir))


@query()
def K11_timeline(spark, sf_dir):
    """What the sky holds from the last event on."""
    now = read(spark, sf_dir, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    return planets.timeline(spark, now)


# -- budgets, feeds, read sets, keys, differences, deals ------------------------------------------------------------

#: Votes in a day, small enough for the supplied votes to use it up.
_DAY, _A_DAY = 86_400, 3


@query(
    _VOTES.replace("with ", "with recursive ", 1) + f""", v as (select vote_id, voter::varchar as key, epoch_us(voted_at) as us, row_number() over (partition by voter order by voted_at, vote_id) as k from votes),
    w as (select vote_id, key, us, k, [us] as acc, [us] as mine, false as refused from v where k = 1
        union all select vote_id, key, us, k, case when len(f) >= {_A_DAY} then f else list_append(f, us) end, list_append(g, us), len(f) >= {_A_DAY}
        from (select v.*, list_filter(w.acc, lambda t: t >= v.us - {_DAY} * 1000000::bigint) as f, list_filter(w.mine, lambda t: t >= v.us - {_DAY} * 1000000::bigint) as g from w join v on v.key = w.key and v.k = w.k + 1))
    select vote_id, key, len(mine) as asked, len(acc) as used, refused from w"""
)
def T07_refused_votes(spark, sf_dir):
    """Votes that a daily budget refuses; refused ones use nothing up, so each verdict depends on those before."""
    return budgets.budgets(votes(spark, sf_dir, groups=None), "voter", _A_DAY, _DAY).drop("voted_at")


@query("select distinct (epoch_us(ts) // 21600000000)::bigint as poll, event_id, value from events")
def S12_feed_items(spark, sf_dir):
    """Events polled every six hours, each body repeating the two before; every event comes once, with the poll that told it first."""
    e = read(spark, sf_dir, "events").select("event_id", "value", F.expr("unix_micros(cast(ts as timestamp)) div 21600000000").alias("first"))
    said = e.select("event_id", "value", F.explode(F.sequence("first", F.col("first") + 2)).alias("poll"))
    folder = work.fresh(spark, "feed")
    feed_source.polled(said, "poll", folder)
    spark.dataSource.register(feed_source.FeedSource)
    items = spark.read.format(feed_source.NAME).load(folder).select("poll", F.from_json("item", "event_id long, value double").alias("x"))
    return items.select("poll", "x.event_id", "x.value")


_READS = "with reads as (select distinct user_id as reader, event_id // 10 as date_id from events where event_type = 'view') "


def _reads(spark, sf_dir):
    return read(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("reader"), F.expr("event_id div 10").alias("date_id"))


@query(_READS + "select doc_id as date_id from documents where doc_id not in (select date_id from reads where reader = 7)")
def P17_unread(spark, sf_dir):
    sets = reads.read_sets(_reads(spark, sf_dir))
    return reads.unread(entries(spark, sf_dir).select("date_id"), sets, 7)


@query(_READS + "select reader, count(*) filter (where date_id <= 500) as n from reads group by reader")
def P17_read_before(spark, sf_dir):
    """How many of the first entries each reader has read, from bitmaps of two halves of the log put together."""
    r = _reads(spark, sf_dir)
    return reads.read_before(reads.merged(reads.read_sets(r.where("date_id % 3 < 2")), reads.read_sets(r.where("date_id % 3 > 0"))), 500)


_SECRET = b"a key for the archive"
_PADS = [p.hex() for p in mac.pads(_SECRET)]


@query(
    f"""with a as (select event_id, unhex(printf('%02x%02x%02x00', 10, user_id % 256, event_id % 7)) as network, case event_type when 'view' then 'firefox' when 'click' then 'edge' when 'error' then 'none' else 'other' end as class from events),
    i as (select event_id, sha256(unhex('{_PADS[0]}') || network || '|'::blob || class::blob) as h from a)
    select event_id, substr(sha256(unhex('{_PADS[1]}') || unhex(h)), 1, 16) as cohort from i"""
)
def X31_cohorts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    address = F.concat_ws(".", F.lit("10"), F.col("user_id") % 256, F.col("event_id") % 7, F.col("event_id") % 250)
    agent = F.when(F.col("event_type") == "view", "Mozilla/5.0 Firefox/1").when(F.col("event_type") == "click", "Chrome Edg/2").when(F.col("event_type") != "error", F.col("event_type"))
    return e.select("event_id", F.lower(F.hex(mac.cohort(_SECRET, address, agent))).alias("cohort"))


@query()
def X31_ballots(spark, sf_dir):
    """Votes as signed ballots, opened again; one in three is opened with another key and gives nothing."""
    v = votes(spark, sf_dir, groups=None).where("left < 2147483648 and right < 2147483648")
    issued, voter = F.unix_millis(F.col("voted_at").cast("timestamp")), F.unhex(F.md5(F.col("voter").cast("string")))
    body = mac.ballot_body(F.lit("beautiful"), F.col("left"), F.col("right"), F.when(F.col("vote_id") % 2 == 0, voter), F.col("outcome") == "tie", issued, F.xxhash64("vote_id"))
    signed = v.select("vote_id", F.when(F.col("vote_id") % 3 == 0, mac.signed(b"another", body)).otherwise(mac.signed(_SECRET, body)).alias("token"))
    return signed.select("vote_id", mac.opened(_SECRET, F.col("token")).alias("b")).select("vote_id", "b.category", "b.left", "b.right", "b.probe", "b.issued_ms", "b.nonce")


@query(
    r"""with t as (select conv_id * 1000 + turn as date_id, role, text from conversations), n as (select date_id, role, text, lag(role) over w as o_role, lag(text) over w as o_text, lag(date_id) over w as o from t window w as (order by date_id)),
    p as (select date_id, unnest(['role', 'text']) as field, unnest([o_role, o_text]) as old, unnest([role, text]) as new from n where o = date_id - 1)
    select date_id, field, len(regexp_extract_all(coalesce(old, ''), '\S+')) as old_words, len(regexp_extract_all(coalesce(new, ''), '\S+')) as new_words from p where old is distinct from new"""
)
def Z27_changed_fields(spark, sf_dir):
    """Fields that differ from one turn to the next; what stays and goes is the old text, what stays and comes the new one."""
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("date_id"), "role", "text")
    found = exchange.changed_fields(turns.withColumn("date_id", F.col("date_id") + 1), turns, ("role", "text"))
    n = lambda kind: exchange.count_words(F.col("diff"), kind)
    return found.select("date_id", "field", (n("same") + n("removed")).cast("long").alias("old_words"), (n("same") + n("added")).cast("long").alias("new_words"))


@query()
def G05_order_chain(spark, sf_dir):
    """(round, a, b): the pairs of a day's order game over all entries with a picture."""
    pool = entries(spark, sf_dir).where("kind = 'image'").select("date_id")
    dates = puzzles.chain(pool, puzzles.Deal.daily("order", 9000))
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(dates, dates[1:]), 1)]
    return spark.createDataFrame(rows, "round int, a long, b long")


@query()
def R01_anchored_fit(spark, sf_dir):
    """The fit with a tenth of the pictures anchored to a baseline."""
    v = votes(spark, sf_dir, groups=None)
    pictures = v.select(F.explode(F.array("left", "right")).alias("picture")).distinct().where("picture % 10 = 0")
    baseline = pictures.select("picture", (F.pmod(F.xxhash64("picture"), F.lit(400)) / 100.0 - 2).alias("score"), F.lit(20.0).alias("ess"))
    return ranking.fit(v, anchors=voting.anchors(baseline)).select("picture", F.round("score", 9).alias("score"), F.round("stderr", 9).alias("stderr"), "comparisons")
