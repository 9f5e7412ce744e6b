"""Normalising creation times of mixed spellings, precisions and zones to one UTC instant.

Every value is parsed under each interpretation that its shape allows. Slashed dates have two (day
first, month first), dates of three two-digit numbers up to three (day, month or year first; years
00 to 68 are of this century). Which order a source uses is a mixture fitted by expectation
maximisation over the source's own values:

* likelihood: a valid reading between 1990 and a day after the record was received (if that is
  known) has 1, any other valid one RARE, an impossible date 0;
* E step: a value is shared among its readings in proportion to likelihood times mixture weight;
* M step: the mixture is the normalised weight plus a symmetric prior count.

A source is a collection. Its sufficient statistics are the counts of values by the likelihoods of
their three readings, 26 numbers at most, so the loop runs inside one Catalyst expression
(``aggregate`` over a sequence) on the aggregated rows: two partially aggregated shuffles of a few
rows a source, whatever the number of values. A declared order of the source is a mixture of
weight one and leaves nothing to estimate. A value whose best posterior stays under ``confidence``
has no instant by this reading and is marked ambiguous; readings of the same instant count together.
The unit of an epoch follows from its length, which leaves no two plausible units.

Defined results: null, blank, unreadable and impossible values give no instant from metadata;
then the time inside a version-1 UUID or a ULID counts; else the instant is null. Null metadata,
a zone name that does not exist and a collection without settings count as absent. Fractions
finer than a microsecond are cut. Repeated rows come out repeated; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Zone abbreviations of the public RFC 822 / CLDR lists with their offsets in minutes.
ZONE_OFFSETS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
BLANKS = " \t\r\n"
LAST_US = 253402300799999999  # 9999-12-31T23:59:59.999999Z
GREGORIAN_TICKS = 122192928000000000  # 100 ns ticks from 1582-10-15 to 1970-01-01

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})?(?:[.,](\d{1,12}))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}))?"
#: Groups: first field, separator, second field, second separator, third field, hour, minute, second, fraction, a/p, zone.
_DATE = r"^(\d{1,4})([-./\s])\s*([A-Za-z]{3,9}|\d{1,2})(?:\.?,?)([-./\s])\s*(\d{1,4})(?:(?:[Tt]|,?\s+)" + _TIME + _ZONE + ")?$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})?"
_EPOCH = r"^(\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})(?:\.(\d{1,12}))?$"
_SEP = "\u0001"


def trimmed(v: Column) -> Column:
    return F.regexp_replace(v, rf"^[{BLANKS}]+|[{BLANKS}]+$", "")


def _int(c: Column) -> Column:
    return F.when(c != "", c).cast("int")


def _zone_offset(z: Column) -> Column:
    """Offset in seconds of a zone mark; null: the mark is absent or unknown."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONE_OFFSETS.items() for x in kv]), F.upper(z)) * 60
    digits = F.regexp_replace(F.substring(z, 2, 5), ":", "")
    h, m = F.substring(digits, 1, 2).cast("int"), F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))
    sign = F.when(z.startswith("-"), -1).otherwise(1)
    return F.when(z.rlike(r"^[+-]\d{2}"), F.when((h <= 18) & (m <= 59), sign * (h * 3600 + m * 60))).otherwise(named)


def _micros(frac: Column) -> Column:
    return F.when(frac != "", F.substring(F.rpad(frac, 6, "0"), 1, 6).cast("int")).otherwise(0)


def _day(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a date, null if there is no such date."""
    z = F.lit(0)
    ts = F.try_make_timestamp_ntz(y, m, d, z, z, z.cast("decimal(16,6)"))
    return F.when(y >= 1, F.unix_date(ts.cast("date")).cast("long"))


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """df with further columns that the optimizer doesn't copy into their users.

    Collapsed projections and pushed filters would repeat these expressions many times over; a
    generator of exactly one row is a border that neither crosses.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def with_readings(df: DataFrame, raw: Column) -> DataFrame:
    """Adds _kind (epoch, plain, slashed, short; null: unreadable), _a, _b, _c and _off.

    _a: wall-clock (or, with a zone or for epochs, also zoned) microseconds of the only reading,
    for slashed and short dates of the day-first one; _b of the month-first, _c of the year-first
    one. _off: seconds, null without a zone. Each step is a projection of its own, so that the
    parts are computed once.
    """
    g = lambda i: F.col("_g")[i]
    n = lambda c: F.col(c)
    v = F.regexp_replace(trimmed(raw), r"^[A-Za-z]{3,9},\s+", "")
    df = _once(df, _v=F.regexp_replace(v, _COMPACT, "$1-$2-$3T$4:$5:$6"))
    df = _once(df, _g=F.when(n("_v").rlike(_DATE), F.split(F.regexp_replace(
        n("_v"), _DATE, _SEP.join(f"${i}" for i in range(1, 12))), _SEP)).when(
        n("_v").rlike(_EPOCH), F.split(F.regexp_replace(n("_v"), _EPOCH, f"$1{_SEP}$2"), _SEP)))
    date = F.size("_g") == 11
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(g(2), 1, 3))).cast("int")
    worded = g(2).rlike("^[A-Za-z]")
    hour, ap = g(5).cast("int"), F.lower(g(9))
    h12 = F.when(ap == "", hour).when(hour.between(1, 12), hour % 12 + F.when(ap == "p", 12).otherwise(0))
    sec = F.when(g(7) == "", 0).otherwise(g(7).cast("int"))
    clock = F.when(g(5) == "", 0).when(
        (h12 <= 23) & (g(6).cast("int") <= 59) & (sec <= 59),
        (h12 * 3600 + g(6).cast("int") * 60 + sec) * F.lit(1_000_000).cast("long") + _micros(g(8)))
    k = F.length(g(0))
    unit = F.when(k <= 10, 1_000_000).when(k <= 13, 1_000).otherwise(1).cast("long")
    whole = g(0).cast("long")
    epoch = F.when(k >= 18, F.expr("_g[0]").cast("long").cast("decimal(19,0)") / 1000).otherwise(
        whole.cast("decimal(19,0)") * unit + F.floor(_micros(g(1)) * unit / F.lit(1_000_000)))
    df = _once(df, _p=F.when(date, F.struct(
        _int(g(0)).alias("x"), g(1).alias("sep"), F.when(worded, month).otherwise(F.when(~worded, g(2)).cast("int")).alias("y"),
        _int(g(4)).alias("z"), worded.alias("w"), clock.alias("clock"),
        (g(1) == g(3)).alias("same"), F.length(g(0)).alias("lx"), F.length(g(2)).alias("ly"), F.length(g(4)).alias("lz"),
        F.when(g(10) != "", _zone_offset(g(10))).alias("off"), (g(10) == "").alias("local"))),
        _epoch=F.when(F.size("_g") == 2, F.floor(epoch).cast("long")))
    q = F.col("_p")
    sep, ok = q["sep"], q["same"] & (q["local"] | q["off"].isNotNull()) & q["clock"].isNotNull()
    blank = sep.rlike(r"\s")
    year_first = (sep == "-") & ~q["w"] & (q["lx"] == 4) & (q["lz"] <= 2)
    day_first = ((sep == ".") & ~q["w"] | (blank | (sep == "-")) & q["w"]) & (q["lx"] <= 2) & (q["lz"] == 4)
    slashed = (sep == "/") & ~q["w"] & (q["lx"] <= 2) & (q["lz"] == 4)
    short = ~blank & ~q["w"] & (q["lx"] == 2) & (q["ly"] == 2) & (q["lz"] == 2)
    century = lambda y: y + F.when(y <= 68, 2000).otherwise(1900)
    kind = F.when(F.col("_epoch").isNotNull(), "epoch").when(ok & (year_first | day_first), "plain").when(ok & slashed, "slashed").when(ok & short, "short")
    df = _once(df, _kind=kind, _ymd=F.when(year_first, F.struct(q["x"].alias("y"), q["y"].alias("m"), q["z"].alias("d")))
               .otherwise(F.struct(F.when(short, century(q["z"])).otherwise(q["z"]).alias("y"), q["y"].alias("m"), q["x"].alias("d"))))
    e = F.col("_ymd")
    us = lambda day: day * F.lit(86_400_000_000).cast("long") + q["clock"]
    a = F.when(F.col("_kind") == "epoch", F.col("_epoch")).when(F.col("_kind").isNotNull(), us(_day(e["y"], e["m"], e["d"])))
    b = F.when((F.col("_kind") == "slashed") | (F.col("_kind") == "short") & (sep != "."), us(_day(e["y"], e["d"], e["m"])))
    c = F.when(F.col("_kind") == "short", us(_day(century(e["d"]), e["m"], q["z"])))
    off = F.when(F.col("_kind") == "epoch", 0).otherwise(q["off"])
    return _once(df, _a=a, _b=b, _c=c, _off=off).drop("_v", "_g", "_p", "_epoch", "_ymd")


def id_instant(cid: Column) -> Column:
    """Microseconds inside a version-1 UUID or a ULID, else null."""
    c, up = F.lower(cid), F.upper(cid)
    uuid = r"^[0-9a-f]{8}-[0-9a-f]{4}-1[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    hexed = F.concat(F.substring(c, 16, 3), F.substring(c, 10, 4), F.substring(c, 1, 8))
    ticks = F.conv(hexed, 16, 10).cast("decimal(20,0)")
    u1 = F.floor((ticks - GREGORIAN_TICKS) / 10).cast("long")
    # Crockford's signs keep their order, so translating them gives base 32 as Java writes it.
    plain = F.translate(F.substring(up, 1, 10), CROCKFORD, "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    ms = F.conv(plain, 32, 10).cast("decimal(20,0)")
    ul = F.when(ms * 1000 <= LAST_US, (ms * 1000).cast("long"))
    return F.when(c.rlike(uuid), u1).when(up.rlike(rf"^[{CROCKFORD}]{{26}}$"), ul)


def _known_zones(spark: SparkSession) -> list[str]:
    """Zone names of the JVM, fetched in one call."""
    jvm = spark._jvm
    return sorted(jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds()).split(","))


READINGS = ("_a", "_b", "_c")
RARE = 1e-3  # likelihood of a reading outside the plausible time
FIRST_US = 631_152_000_000_000  # 1990-01-01


def likelihoods(received: Column) -> dict[str, Column]:
    """_wa, _wb, _wc: of the readings; received: microseconds or null."""
    def one(t: Column) -> Column:
        early = t < FIRST_US
        late = F.coalesce(t > received + 86_400_000_000, F.lit(False))
        return F.when(t.isNull(), 0.0).when(early | late, RARE).otherwise(1.0)

    return {f"_w{x[1]}": one(F.col(x)) for x in READINGS}


def fit_orders(parsed: DataFrame, rounds: int = 20, prior: float = 0.5) -> DataFrame:
    """(_src, _pa, _pb, _pc): the fitted mixture of day-first, month-first and year-first dates of each source."""
    a, b, c = (F.col(x) for x in READINGS)
    same = F.coalesce((a == b) & c.isNull(), F.lit(False))  # tells nothing
    live = parsed.filter(F.col("_kind").isin("slashed", "short") & ~same & (a.isNotNull() | b.isNotNull() | c.isNotNull()))
    count = live.groupBy("collection", "_wa", "_wb", "_wc").agg(F.count("*").alias("_n"), F.max("_order").alias("_o"))
    stats = count.groupBy("collection").agg(F.collect_list(F.struct("_wa", "_wb", "_wc", "_n")).alias("_s"), F.max("_o").alias("_o"))  # 26 patterns at most
    triple = lambda x, y, z: F.struct(x.alias("a"), y.alias("b"), z.alias("c"))

    def step(p: Column, _: Column) -> Column:
        def add(t: Column, s: Column) -> Column:
            w = [s["_wa"] * p["a"], s["_wb"] * p["b"], s["_wc"] * p["c"]]
            k = s["_n"] / (w[0] + w[1] + w[2])
            return triple(t["a"] + k * w[0], t["b"] + k * w[1], t["c"] + k * w[2])

        t = F.aggregate("_s", triple(*[F.lit(prior)] * 3), add)
        return F.transform(F.array(t), lambda t: triple(*[t[x] / (t["a"] + t["b"] + t["c"]) for x in "abc"]))[0]

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), triple(*[F.lit(1 / 3)] * 3), step)
    one = lambda *p: triple(*map(F.lit, p))
    p = F.when(F.col("_o") == "DMY", one(1.0, 0.0, 0.0)).when(F.col("_o") == "MDY", one(0.0, 1.0, 0.0)).otherwise(fitted)
    return stats.select(F.col("collection").alias("_src"), F.inline(F.array(p)).alias("_pa", "_pb", "_pc"))


def resolve_instants(records: DataFrame, settings: DataFrame, confidence: float = 0.9) -> DataFrame:
    """records plus utc_us, instant_source and ambiguous.

    records needs collection, chunk_id, metadata; settings: collection, default_tz, date_order.
    instant_source: metadata_field, uuid_v1 or ulid, null without an instant.
    """
    spark = records.sparkSession
    zones = _known_zones(spark)
    names = records.columns
    s = settings.groupBy(F.col("collection").alias("_c")).agg(
        F.max("default_tz").alias("_tz"), F.max(F.upper(F.trim("date_order"))).alias("_order"))
    md = F.col("metadata")
    # The source's value under the first of its two names that is not null.
    parsed = with_readings(
        records.join(s, F.col("collection") == F.col("_c"), "left").drop("_c"),
        F.coalesce(F.try_element_at(md, F.lit("created_at")), F.try_element_at(md, F.lit("createdAt"))),
    ).withColumn("_mz", F.try_element_at(md, F.lit("tz")))
    received = F.unix_micros(F.col("received_at").cast("timestamp")) if "received_at" in names else F.lit(None).cast("long")
    parsed = _once(parsed, **likelihoods(received))
    fit = fit_orders(parsed.select("collection", "_kind", *READINGS, "_wa", "_wb", "_wc", "_order"))
    j = parsed.join(fit, F.col("collection") == F.col("_src"), "left").drop("_src")
    mixed = F.col("_kind").isin("slashed", "short")
    a, b, c = (F.col(x) for x in READINGS)
    share = [F.col(f"_w{x}") * F.coalesce(f"_p{x}", F.lit(1 / 3)) for x in "abc"]
    j = _once(j, **{f"_q{x}": F.when(mixed, w) for x, w in zip("abc", share)})
    qs = [F.col(f"_q{x}") for x in "abc"]
    total = qs[0] + qs[1] + qs[2]
    # Posterior of each reading's instant; null: no reading has any weight.
    post = {f"_r{x}": F.when(total > 0, sum(F.when(t == u, q).otherwise(0.0) for u, q in zip((a, b, c), qs)) / total) for x, t in zip("abc", (a, b, c))}
    j = _once(j, **post)
    sure = [F.coalesce(F.col(f"_r{x}") >= confidence, F.lit(False)) for x in "abc"]
    wall = F.when(~mixed, a).when(sure[0], a).when(sure[1], b).when(sure[2], c)
    j = _once(j, _ambiguous=F.coalesce(mixed & (total > 0) & ~(sure[0] | sure[1] | sure[2]), F.lit(False)))
    known = ", ".join(f"'{z}'" for z in zones)  # as SQL: one call instead of a thousand
    zone = F.expr(f"coalesce(CASE WHEN _mz IN ({known}) THEN _mz END, CASE WHEN _tz IN ({known}) THEN _tz END, 'UTC')")
    j = _once(j, _wall=F.when(wall.between(-62135596800000000, LAST_US), wall), _z=zone)
    # The local hour of a clock change is read as java.time does: first pass, or forward by the gap.
    w = F.col("_wall")
    ntz = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(_wall as decimal(20,0)) / 1000000)")
    j = _once(j, _u=F.when(F.col("_off").isNull() & w.isNotNull(), F.convert_timezone(F.col("_z"), F.lit("UTC"), ntz)))
    u = F.col("_u")
    zoned = (F.unix_date(u.cast("date")).cast("long") * 86_400 + F.hour(u) * 3600 + F.minute(u) * 60) * 1_000_000 + (
        F.expr("extract(SECOND FROM _u)") * 1_000_000).cast("long")
    meta = F.when(F.col("_off").isNotNull(), w - F.col("_off") * F.lit(1_000_000).cast("long")).otherwise(zoned)
    j = _once(_once(j, _m=meta), _i=F.when(F.col("_m").isNull(), id_instant(F.col("chunk_id"))))
    return j.select(
        *names, F.coalesce("_m", "_i").alias("utc_us"),
        F.when(F.col("_m").isNotNull(), "metadata_field").when(
            F.col("_i").isNotNull(), F.when(F.length("chunk_id") == 36, "uuid_v1").otherwise("ulid")).alias("instant_source"),
        F.col("_ambiguous").alias("ambiguous"))
