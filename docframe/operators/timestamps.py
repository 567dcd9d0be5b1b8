"""Bring timestamps written in many forms and zones to one UTC instant, and dates to one ISO day.

All parsing is JVM expressions. A stamp is read in this order: epoch numbers (seconds,
milliseconds, microseconds, nanoseconds, seconds with a fraction), year-first dates, compact dates,
slashed dates (``date_order`` unless only the other order names a real day), dotted dates (day
first), dates with month names. A zone in the stamp wins (offset, then named zone, then an
abbreviation of the root's zone); without one the root's zone holds. Of a local time that occurs
twice the earlier instant is meant, a skipped one moves forward by the gap.

Roots without a declared zone get the zone history that violates the evidence least, see
``estimate_zones``.

Defined cases: null, empty or unreadable stamps, days that do not exist, unknown zones and stamps
without a time of day (where an instant is asked for) give null. A path under no root has no zone
and month-first order is not assumed: an ambiguous slashed date is read day first. Repeated rows are
each converted. Empty tables give empty results.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docframe.session import checkpoint

# Month names (English, German, French, Spanish, Italian, Portuguese) and their common short forms.
MONTHS = (
    ("january", "jan", "januar", "jänner", "janvier", "janv", "enero", "ene", "gennaio", "janeiro"),
    ("february", "feb", "februar", "février", "fevrier", "févr", "febrero", "febbraio", "fevereiro", "fev"),
    ("march", "mar", "märz", "mär", "maerz", "mars", "marzo", "março"),
    ("april", "apr", "avril", "avr", "abril", "abr", "aprile"),
    ("may", "mai", "mayo", "maggio", "maio"),
    ("june", "jun", "juni", "juin", "junio", "giugno", "junho"),
    ("july", "jul", "juli", "juillet", "juil", "julio", "luglio", "julho"),
    ("august", "aug", "août", "aout", "agosto", "ago"),
    ("september", "sep", "sept", "septembre", "septiembre", "settembre", "setembro"),
    ("october", "oct", "oktober", "okt", "octobre", "octubre", "ottobre", "outubro"),
    ("november", "nov", "novembre", "noviembre", "novembro"),
    ("december", "dec", "dezember", "dez", "décembre", "decembre", "déc", "diciembre", "dic", "dicembre", "dezembro"),
)
YEAR_FIRST = r"^([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})(?![0-9])(.*)$"
COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:[T ]?([0-9]{2})([0-9]{2})([0-9]{2})?(?:[.,][0-9]+)?(.*))?$"
SLASHED = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})(?![0-9])(.*)$"
DOTTED = r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4}|[0-9]{2})(?![0-9])(.*)$"
DAY_NAME = r"^(?:\p{L}+\.?,? +)?([0-9]{1,2})(?:\.|st|nd|rd|th|er|º)?[ -]+(?:de )?(\p{L}+)\.?[ -]+(?:de[l]? )?([0-9]{4})(?![0-9])(.*)$"
NAME_DAY = r"^(\p{L}+)\.? ([0-9]{1,2})(?:st|nd|rd|th)?,? ([0-9]{4})(?![0-9])(.*)$"
CTIME = r"^\p{L}{3} (\p{L}{3}) +([0-9]{1,2}) ([0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?) ?(.*?) ?([0-9]{4})$"
CLOCK = r"^(?:T|,? +)?([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]+)?)?(?: ?([AaPp])\.?[Mm]\.?(?![A-Za-z]))?(?![0-9])(.*)$"
OFFSET = r"^([+-])([0-9]{2}):?([0-9]{2})$"


def _month_map() -> Column:
    # one literal that Catalyst folds: hundreds of them cost more to plan than the query to run
    pairs = ",".join(f"{n}:{i}" for i, names in enumerate(MONTHS, 1) for n in names)
    return F.str_to_map(F.lit(pairs), F.lit(","), F.lit(":")).cast("map<string,int>")


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _year(text: Column) -> Column:
    return F.when(F.length(text) == 2, text.try_cast("int") + 2000).otherwise(text.try_cast("int"))


def _real(y: Column, m: Column, d: Column) -> Column:
    return m.between(1, 12) & d.between(1, 31) & (y >= 1) & F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), m.cast("string"), d.cast("string")).try_cast("date").isNotNull()


def let(value: Column, body) -> Column:
    """``body`` of ``value`` evaluated once: without it Catalyst would copy the parser into every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_date(s: Column, date_order: Column) -> Column:
    """struct(y, m, d, rest) of a written date, null where none is found. ``rest`` is what follows it."""
    months = _month_map()

    def month(pattern: str, group: int) -> Column:
        return F.try_element_at(months, F.lower(F.regexp_extract(s, pattern, group)))

    def part(y: Column, m: Column, d: Column, rest: Column) -> Column:
        return F.struct(y.alias("y"), m.alias("m"), d.alias("d"), rest.alias("rest"))

    def ordered(x: Column) -> Column:
        month_first, day_first = _real(x["y"], x["a"], x["b"]), _real(x["y"], x["b"], x["a"])
        mdy = F.when(date_order == "mdy", month_first | ~day_first).otherwise(month_first & ~day_first)
        return part(x["y"], F.when(mdy, x["a"]).otherwise(x["b"]), F.when(mdy, x["b"]).otherwise(x["a"]), x["rest"])

    slashed = F.struct(_int(s, SLASHED, 1).alias("a"), _int(s, SLASHED, 2).alias("b"), _year(F.regexp_extract(s, SLASHED, 3)).alias("y"), F.regexp_extract(s, SLASHED, 4).alias("rest"))
    compact_rest = F.when(
        F.regexp_extract(s, COMPACT, 4) != "",
        F.concat(F.lit(" "), F.regexp_extract(s, COMPACT, 4), F.lit(":"), F.regexp_extract(s, COMPACT, 5), F.when(F.regexp_extract(s, COMPACT, 6) != "", F.concat(F.lit(":"), F.regexp_extract(s, COMPACT, 6))).otherwise(""), F.regexp_extract(s, COMPACT, 7)),
    ).otherwise("")
    return (
        F.when(s.rlike(YEAR_FIRST), part(_int(s, YEAR_FIRST, 1), _int(s, YEAR_FIRST, 3), _int(s, YEAR_FIRST, 4), F.regexp_extract(s, YEAR_FIRST, 5)))
        .when(s.rlike(COMPACT), part(_int(s, COMPACT, 1), _int(s, COMPACT, 2), _int(s, COMPACT, 3), compact_rest))
        .when(s.rlike(SLASHED), let(slashed, ordered))
        .when(s.rlike(DOTTED), part(_year(F.regexp_extract(s, DOTTED, 3)), _int(s, DOTTED, 2), _int(s, DOTTED, 1), F.regexp_extract(s, DOTTED, 4)))
        .when(s.rlike(CTIME), part(_int(s, CTIME, 5), month(CTIME, 1), _int(s, CTIME, 2), F.concat(F.lit(" "), F.regexp_extract(s, CTIME, 3), F.lit(" "), F.regexp_extract(s, CTIME, 4))))
        .when(s.rlike(DAY_NAME), part(_int(s, DAY_NAME, 3), month(DAY_NAME, 2), _int(s, DAY_NAME, 1), F.regexp_extract(s, DAY_NAME, 4)))
        .when(s.rlike(NAME_DAY), part(_int(s, NAME_DAY, 3), month(NAME_DAY, 1), _int(s, NAME_DAY, 2), F.regexp_extract(s, NAME_DAY, 4)))
    )


def iso_day(text: Column, date_order: Column) -> Column:
    """``yyyy-MM-dd`` of a written date, null where it names no real day."""

    def day(p: Column) -> Column:
        done = (F.trim(p["rest"]) == "") | p["rest"].rlike(CLOCK)
        return F.when(done & _real(p["y"], p["m"], p["d"]), F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"]))

    return let(F.trim(text), lambda s: let(split_date(s, date_order), day))


def epoch(text: Column) -> Column:
    """Instant of a bare epoch number, null for anything else."""
    return (
        F.when(text.rlike(r"^-?[0-9]{9,10}([.,][0-9]+)?$"), F.timestamp_seconds(F.regexp_extract(text, r"^(-?[0-9]+)", 1).try_cast("bigint")))
        .when(text.rlike(r"^[0-9]{12,13}$"), F.timestamp_millis(text.try_cast("bigint")))
        .when(text.rlike(r"^[0-9]{15,16}$"), F.timestamp_micros(text.try_cast("bigint")))
        .when(text.rlike(r"^[0-9]{18,19}$"), F.timestamp_micros(F.floor(text.try_cast("decimal(38,0)") / 1000).try_cast("bigint")))
    )


def parse(text: Column, date_order: Column) -> Column:
    """struct(epoch, local, zone) of a stamp: an instant, or a wall clock (as if UTC) and the zone it is written with."""

    def made(e: Column, local: Column, zone: Column) -> Column:
        return F.struct(e.alias("epoch"), local.alias("local"), zone.alias("zone"))

    no_time, no_text = F.lit(None).cast("timestamp"), F.lit("")

    def clock(d: Column) -> Column:
        rest = d["rest"]
        c = F.struct(
            _int(rest, CLOCK, 1).alias("h"), _int(rest, CLOCK, 2).alias("mi"), F.coalesce(_int(rest, CLOCK, 3), F.lit(0)).alias("s"),
            F.lower(F.regexp_extract(rest, CLOCK, 4)).alias("half"), F.trim(F.regexp_extract(rest, CLOCK, 5)).alias("zone"),
        )

        def wall(c: Column) -> Column:
            hour = F.when(c["half"] == "", F.when(c["h"] <= 23, c["h"])).when(c["h"].between(1, 12), c["h"] % 12 + F.when(c["half"] == "p", 12).otherwise(0))
            real = _real(d["y"], d["m"], d["d"]) & hour.isNotNull() & (c["mi"] < 60) & (c["s"] < 60)
            local = F.when(real, F.try_make_timestamp(d["y"], d["m"], d["d"], hour, c["mi"], c["s"].cast("decimal(8,6)"), F.lit("UTC")))
            return made(no_time, local, c["zone"])

        return F.when(rest.rlike(CLOCK), let(c, wall)).otherwise(made(no_time, no_time, no_text))

    def stamp(s: Column) -> Column:
        return let(epoch(s), lambda e: F.when(e.isNotNull(), made(e, no_time, no_text)).otherwise(let(split_date(s, date_order), clock)))

    return let(F.trim(text), stamp)


@lru_cache(maxsize=1)
def known_zones() -> tuple[str, ...]:
    return tuple(sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("posix/", "right/"))))


@lru_cache(maxsize=1)
def abbreviations(since: int = 1990, until: int = 2038) -> tuple[tuple[str, str, int], ...]:
    """(zone, abbreviation, offset in seconds) of every known zone; the latest use of an abbreviation wins.

    A table of the time zone database, some thousand rows whatever the data; it is joined, not looked up for the roots at hand.
    """
    out: dict[tuple[str, str], int] = {}
    for name in (*known_zones(), "UTC"):
        zone = zoneinfo.ZoneInfo(name)
        for y in range(since, until):
            for m in (1, 2, 4, 5, 7, 8, 10, 11):
                at = dt.datetime(y, m, 15, tzinfo=zone)
                if (short := at.tzname()) and short[0].isalpha():
                    out[name, short] = int(at.utcoffset().total_seconds())
    return tuple((z, a, s) for (z, a), s in sorted(out.items()))


def with_abbreviation(df: DataFrame, zone: str, written: Column) -> DataFrame:
    """Add ``_abbr_s``, the offset that the abbreviation ``written`` has in the zone, null where it has none."""
    # through Arrow it is a local relation of known size, which Spark broadcasts by its own threshold
    rows = df.sparkSession.createDataFrame(pd.DataFrame(abbreviations(), columns=["_az", "_aa", "_abbr_s"]), "_az string, _aa string, _abbr_s int")
    return df.join(rows, (F.col(zone) == F.col("_az")) & (written == F.col("_aa")), "left").drop("_az", "_aa")


def to_instant(p: Column, zone: Column, abbr_s: Column) -> Column:
    """UTC instant of what ``parse`` read, in a root of the given zone; ``abbr_s`` is the offset of its abbreviation there."""
    local, z = p["local"], p["zone"]
    named = F.regexp_extract(z, r"^\[?([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)\]?$", 1)
    bare = F.regexp_replace(z, r"\[[^\]]*\]$", "")
    hh, mm = _int(bare, OFFSET, 2), _int(bare, OFFSET, 3)
    seconds = F.when((hh <= 18) & (mm < 60), (hh * 3600 + mm * 60) * F.when(F.regexp_extract(bare, OFFSET, 1) == "-", -1).otherwise(1))
    known = F.split(F.lit(",".join(known_zones())), ",")

    def minus(sec: Column) -> Column:
        return F.timestamp_micros(F.unix_micros(local) - sec.cast("bigint") * 1_000_000)

    stated = (
        F.when(bare.rlike(OFFSET), minus(seconds))
        .when(z.rlike(r"^\[?(?:Z|z|UTC|GMT|Etc/UTC)\]?$"), local)
        .when(named != "", F.when(F.array_contains(known, named), F.to_utc_timestamp(local, named)))
        .when(z != "", minus(abbr_s))
        .otherwise(F.to_utc_timestamp(local, zone))
    )
    return F.coalesce(p["epoch"], F.when(local.isNotNull(), stated))


def utc_text(ts: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def with_root(df: DataFrame, path_col: str, scan_roots: DataFrame) -> DataFrame:
    """Add root_path, zone_name and date_order of the deepest root that begins the path (equi-joins on prefixes)."""
    roots = scan_roots.filter("root_path is not null").select(F.rtrim("root_path", F.lit("/")).alias("_root"), "zone_name", "date_order").dropDuplicates(["_root"])
    depth = F.size(F.split("_root", "/"))
    depths = sorted((r[0] for r in roots.select(depth).distinct().collect()), reverse=True)  # path depths, a few small numbers
    own = [c for c in df.columns if c not in ("root_path", "zone_name", "date_order")]
    out, found = df.select(*own), []
    for n in depths:
        side = roots.filter(depth == n).select(F.col("_root").alias(f"_r{n}"), F.struct(F.col("_root").alias("root_path"), "zone_name", "date_order").alias(f"_v{n}"))
        out = out.withColumn(f"_p{n}", F.array_join(F.slice(F.split(path_col, "/"), 1, n), "/"))
        out = out.join(side, F.col(f"_p{n}") == F.col(f"_r{n}"), "left").drop(f"_p{n}", f"_r{n}")
        found.append(F.col(f"_v{n}"))
    empty = F.lit(None).cast("struct<root_path:string,zone_name:string,date_order:string>")
    best = F.coalesce(*found, empty)
    return out.withColumn("_v", best).select(*own, "_v.root_path", "_v.zone_name", "_v.date_order")


def evidence(stamps: DataFrame) -> DataFrame:
    """Local stamps of a group aligned with absolute stamps of the same file and change.

    ``stamps``: group, path, _local, instant (null where the stamp has no zone of its own), seen_at. Offsets are multiples of 15 minutes, so both stamps agree modulo 900 seconds. A file and
    residue with one local and one absolute stamp is evidence; ambiguous ones are not. Both sides are
    aggregated before the join, so a hot path costs one row. Returns group, hour (of the instant),
    offset_s, n.
    """
    residue = (F.unix_seconds("t") % 900).alias("residue")
    absolute = stamps.filter("instant is not null").select("group", "path", F.col("instant").alias("t"))
    absolute = absolute.groupBy("group", "path", residue).agg(F.min("t").alias("instant"), F.max("t").alias("hi")).filter("instant = hi")
    local = stamps.filter("instant is null and _local is not null").select("group", "path", F.col("_local").alias("t"))
    local = local.groupBy("group", "path", residue).agg(F.min("t").alias("local"), F.max("t").alias("hi")).filter("local = hi")
    both = absolute.join(local, ["group", "path", "residue"])
    offset = F.unix_seconds("local") - F.unix_seconds("instant")
    both = both.select("group", F.date_trunc("hour", "instant").alias("hour"), offset.alias("offset_s"))
    return both.filter("abs(offset_s) <= 15 * 3600").groupBy("group", "hour", "offset_s").agg(F.count("*").alias("n"))


def estimate_zones(ev: DataFrame, future: DataFrame | None = None, preferred: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Per group the zone of the time zone database whose offset history the evidence contradicts least.

    ``ev`` as of ``evidence``; ``future`` (group, local, seen_at, n) adds the rule that no stamp is later than
    the time it was seen; ``names`` (group, abbr, n) that the zone must know the abbreviations written. Returns group, zone_name, violations, support. Many zones share a history; ties go to a zone
    of ``preferred`` (zone_name), then to the first name.
    """
    zones = F.explode(F.split(F.lit(",".join((*known_zones(), "UTC"))), ",")).alias("zone_name")
    tested = ev.select("group", "hour", "offset_s", "n", zones)
    expected = F.unix_seconds(F.from_utc_timestamp("hour", F.col("zone_name"))) - F.unix_seconds("hour")
    tested = tested.select("group", "zone_name", "n", (expected != F.col("offset_s")).alias("bad"))
    if future is not None:
        late = future.select("group", zones, "n", "local", "seen_at")
        tested = tested.unionByName(late.select("group", "zone_name", "n", (F.to_utc_timestamp("local", F.col("zone_name")) > F.col("seen_at")).alias("bad")))
    if names is not None:
        known = with_abbreviation(names.select("group", "abbr", "n", zones), "zone_name", F.col("abbr"))
        tested = tested.unionByName(known.select("group", "zone_name", "n", F.col("_abbr_s").isNull().alias("bad")))
    score = tested.groupBy("group", "zone_name").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("violations"), F.sum("n").alias("support"))
    other = F.lit(0)
    if preferred is not None:
        score = score.join(preferred.select("zone_name", F.lit(0).alias("_p")).distinct(), "zone_name", "left")
        other = F.coalesce("_p", F.lit(1))
    best = F.min_by(F.struct("zone_name", "violations", "support"), F.struct("violations", other, "zone_name"))
    return score.groupBy("group").agg(best.alias("b")).select("group", "b.*")


def _stamps(df: DataFrame, path_col: str, seen: Column, roots: DataFrame) -> DataFrame:
    """Input of ``evidence``; only epochs and stamps with UTC or an offset count as absolute."""
    one = with_root(df.withColumn("_seen", seen), path_col, roots)
    one = one.select(F.col("root_path").alias("group"), F.col(path_col).alias("path"), F.explode(F.array(parse(F.col("mod_time"), F.col("date_order")))).alias("p"), F.col("_seen").alias("seen_at"))
    own = F.regexp_replace("p.zone", r"\[[^\]]*\]$", "").rlike(OFFSET) | F.col("p.zone").rlike("^(Z|UTC|GMT)$") | F.col("p.epoch").isNotNull()
    one = one.select("group", "path", F.col("p.local").alias("_local"), F.when(own, to_instant(F.col("p"), F.lit("UTC"), F.lit(None).cast("int"))).alias("instant"), "seen_at", F.col("p.zone").alias("_zone"))
    return one.filter("group is not null and (instant is not null or _local is not null)")


def root_zones(file_entries: DataFrame, metadata_results: DataFrame, scan_roots: DataFrame, only_missing: bool = False) -> DataFrame:
    """Estimated zone of every root next to the declared one: root_path, declared, zone_name, violations, support.

    Every zone of the database is a candidate. ``only_missing`` estimates only roots that declare none.
    """
    parts = _stamps(file_entries, "path", F.col("scanned_at"), scan_roots).unionByName(_stamps(metadata_results, "file_path", F.lit(None).cast("timestamp"), scan_roots))
    declared = scan_roots.select(F.rtrim("root_path", F.lit("/")).alias("group"), F.col("zone_name").alias("declared"))
    if only_missing:
        parts = parts.join(declared.filter("declared is null").select("group"), "group", "left_semi")
    parts = checkpoint(parts)  # slim rows, read three times below
    names = parts.filter(F.col("_zone").rlike("^[A-Z]{2,5}$") & ~F.col("_zone").isin("Z", "UTC", "GMT")).groupBy("group", F.col("_zone").alias("abbr")).agg(F.count("*").alias("n"))
    parts = parts.filter("instant is not null or _zone = ''")
    late = parts.filter("instant is null and _local is not null and seen_at is not null").groupBy("group", F.date_trunc("day", "_local").alias("local"), F.date_trunc("day", "seen_at").alias("seen_at")).agg(F.count("*").alias("n"))
    late = late.filter(F.col("seen_at") <= F.col("local") + F.expr("interval 2 days"))
    found = estimate_zones(evidence(parts), late, scan_roots.filter("zone_name is not null").select("zone_name"), names)
    return declared.join(found, "group", "left").select(F.col("group").alias("root_path"), "declared", "zone_name", "violations", "support")


def complete_roots(file_entries: DataFrame, metadata_results: DataFrame, scan_roots: DataFrame) -> DataFrame:
    """``scan_roots`` with missing zones estimated; declared zones hold. A root without any evidence stays without a zone."""
    if scan_roots.filter("zone_name is null").isEmpty():
        return scan_roots
    est = root_zones(file_entries, metadata_results, scan_roots, only_missing=True).select(F.col("root_path").alias("_g"), F.col("zone_name").alias("_z"))
    out = scan_roots.join(est, F.rtrim("root_path", F.lit("/")) == F.col("_g"), "left")
    return checkpoint(out.withColumn("zone_name", F.coalesce("zone_name", "_z")).drop("_g", "_z"))  # a row per root, used in three plans


def normalised(file_entries: DataFrame, metadata_results: DataFrame, links_results: DataFrame, scan_roots: DataFrame) -> DataFrame:
    """source_table, row_id, item_no, normal_form of every stamp that names a real instant or day."""
    roots = complete_roots(file_entries, metadata_results, scan_roots)

    def kept(value: Column) -> Column:
        """The value, dropping rows without one; a generator keeps Catalyst from parsing twice, for the filter and the result."""
        return F.explode(F.filter(F.array(value), lambda x: x.isNotNull())).alias("normal_form")

    def instants(df: DataFrame, name: str, id_col: str, path_col: str) -> DataFrame:
        one = with_root(df.select(id_col, path_col, "mod_time"), path_col, roots)
        # a generator, so that the stamp is parsed once and not again for the join and the result
        one = one.select(id_col, "zone_name", F.explode(F.array(parse(F.col("mod_time"), F.col("date_order")))).alias("p"))
        one = with_abbreviation(one, "zone_name", F.col("p.zone"))
        value = utc_text(to_instant(F.col("p"), F.col("zone_name"), F.col("_abbr_s")))
        return one.select(F.lit(name).alias("source_table"), F.col(id_col).cast("bigint").alias("row_id"), F.lit(0).alias("item_no"), kept(value))

    files = instants(file_entries, "file_entries", "entry_id", "path")
    meta = instants(metadata_results, "metadata_results", "meta_id", "file_path")
    days = links_results.select("links_id", "file_path", F.posexplode("dates").alias("at", "stamp"))
    days = with_root(days, "file_path", roots)
    days = days.select(F.lit("links_results").alias("source_table"), F.col("links_id").cast("bigint").alias("row_id"), (F.col("at") + 1).alias("item_no"), kept(iso_day(F.col("stamp"), F.col("date_order"))))
    return files.unionByName(meta).unionByName(days)
