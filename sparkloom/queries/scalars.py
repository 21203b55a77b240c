"""Scalar functions over the probe table and the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrow as P
from ..functions import nested as J
from ..functions import numeric as N
from ..functions import temporal as D
from ..functions import text as S
from .registry import Registry

Q = Registry()
c = F.col
E = Q.exprs
WIDE = "CASE WHEN i < 1000 THEN i END"


def small():
    return F.when(c("i") < 1000, c("i"))


# -- arithmetic ------------------------------------------------------------------------------------------------------
E("j01_plus_minus_times", "probe", "id", {"a": ("CAST(i AS BIGINT) + j", "CAST(i AS BIGINT) + j"), "b": ("i - 1", "i - 1"), "t": ("CAST(i AS BIGINT) * j", "CAST(i AS BIGINT) * j")})
E("j02_division", "probe", "id", {"a": (lambda: N.divide(c("i"), c("j")), "CAST(i AS DOUBLE) / j"), "b": (lambda: N.divide(c("d"), F.lit(4)), "d / 4"), "n": (lambda: N.divide(c("n"), F.lit(3)), "n / 3")})
E("j03_integer_division", "probe", "id", {"a": (lambda: N.int_divide(c("i"), c("j")), "i // nullif(j, 0)")})
E("j04_modulo", "probe", "id", {"a": (lambda: N.modulo(c("i"), c("j")), "i % nullif(j, 0)"), "b": (lambda: N.modulo(c("i"), F.lit(3)), "mod(i, 3)")})
E("j05_sign_abs", "probe", "id", {"neg": ("-j", "-j"), "a": ("abs(i)", "abs(i)"), "s": (lambda: N.sign(c("i")).cast("bigint"), "CAST(sign(i) AS BIGINT)")})
E("j06_math", "probe", "id", {"ce": (lambda: F.ceil("d").cast("double"), "ceil(d) + 0"), "fl": (lambda: F.floor("d").cast("double"), "floor(d) + 0"), "sq": (lambda: N.round_double(F.sqrt(F.abs("d")), 9), "round(sqrt(abs(d)), 9)"), "ex": (lambda: N.round_double(F.exp(c("j")), 9), "round(exp(j), 9)"), "ln": (lambda: N.round_double(F.log(F.abs("d")), 9), "round(ln(abs(d)), 9)")})
E("j07_logarithms", "probe", "id", {"a": (lambda: N.round_double(N.log(F.abs("d")), 9), "round(log(abs(d)), 9)"), "b": (lambda: N.round_double(N.log(F.abs("d") + 1, F.lit(2.0)), 9), "round(log(2, abs(d) + 1), 9)")})
_TRIG = {f: (f"round({f}(j / 8.0D), 9)", f"round({f}(j / 8.0::DOUBLE), 9)") for f in ("sin", "cos", "tan", "asin", "acos", "atan", "cosh", "sinh", "tanh", "asinh", "atanh", "cbrt", "degrees", "radians")}
E("j08_trigonometry", "probe", "id", _TRIG | {"l2": ("round(log2(abs(j) + 1), 9)", "round(log2(abs(j) + 1), 9)"), "at": ("round(atan2(j, 3), 9)", "round(atan2(j, 3), 9)"), "ah": ("round(acosh(abs(j) + 1), 9)", "round(acosh(abs(j) + 1), 9)")})
E("j09_power", "probe", "id", {"a": ("power(j, 3)", "power(j, 3)"), "b": ("power(CAST(j AS DOUBLE), 2)", "j ** 2"), "p": ("pow(2, j)", "2 ^ j")})
E("j10_round_double", "probe", "id", {"a": (lambda: N.round_double(c("d"), 2), "round(d, 2)"), "b": (lambda: N.round_double(c("d")), "round(d)"), "k": (lambda: N.round_double(F.lit(0.285), 2), "round(0.285::DOUBLE, 2)"), "m": (lambda: N.round_double(F.lit(2.675), 2), "round(2.675::DOUBLE, 2)")})
E("j10_round_prices", "lineitem", "l_orderkey", {"a": (lambda: N.round_double(c("l_extendedprice") * c("l_discount"), 2), "round(l_extendedprice * l_discount, 2)"), "b": (lambda: N.round_double(c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax")), 1), "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 1)")})
E("j11_round_decimal", "probe", "id", {"a": ("CAST(round(n, 1) AS DECIMAL(10,1))", "CAST(round(n, 1) AS DECIMAL(10,1))"), "b": ("CAST(round(n) AS DECIMAL(10,0))", "CAST(round(n) AS DECIMAL(10,0))"), "i": ("round(CAST(i AS BIGINT), -1)", "CAST(round(CAST(i AS BIGINT), -1) AS BIGINT)")})
E("j12_trunc", "probe", "id", {"a": (lambda: N.trunc(c("d")), "trunc(d) + 0"), "b": (lambda: N.trunc(c("d") * 1.37, 1), "trunc(d * 1.37 * 10) / 10 + 0")})
E("j13_round_even", "probe", "id", {"a": (lambda: F.rint(c("d")), "round_even(d, 0)")})
E("j14_greatest_least", "probe", "id", {"g": ("greatest(i, j, 3)", "greatest(i, j, 3)"), "l": ("least(i, j, 3)", "least(i, j, 3)")})
E("j15_factorial", "nation", "n_nationkey", {"f": (lambda: N.factorial(c("n_nationkey")), "CAST(factorial(n_nationkey) AS DECIMAL(38,0))")})
E("j16_gcd_lcm", "part", "p_partkey", {"g": (lambda: N.gcd(c("p_partkey"), c("p_size")), "gcd(p_partkey, p_size)"), "l": (lambda: N.lcm(c("p_size"), F.lit(12)), "CAST(lcm(p_size, 12) AS BIGINT)")})
E("j17_special_values", "probe", "id", {"n": (lambda: N.is_nan(N.divide(c("i"), c("j"))), "isnan(CAST(i AS DOUBLE) / j)"), "f": (lambda: N.is_inf(N.divide(c("i"), c("j"))), "isinf(CAST(i AS DOUBLE) / j)"), "k": (lambda: N.is_finite(c("d")), "isfinite(d)")})
E("j18_even_gamma", "probe", "id", {"e": (lambda: N.even(c("d")), "even(d)")})
E("j19_bits", "probe", "id", {"a": ("i & j", "i & j"), "o": ("i | j", "i | j"), "n": ("~i", "~i"), "x": ("i ^ j", "xor(i, j)")})
E("j20_shift_left", "probe", "id", {"a": (lambda: N.shift_left(small().cast("bigint"), F.lit(5)), f"CASE WHEN {WIDE} < 0 THEN {WIDE} * 32 ELSE CAST({WIDE} AS BIGINT) << 5 END")})
E("j21_shift_right", "probe", "id", {"a": (lambda: N.shift_right(c("i").cast("bigint"), F.abs(c("j"))), "CAST(i AS BIGINT) >> abs(j)")})
E("j22_lengths_in_bits", "probe", "id", {"c": (lambda: N.bit_count(c("i"), 32), "CAST(bit_count(i) AS BIGINT)"), "b": (lambda: F.bit_length("s").cast("bigint"), "CAST(bit_length(s) AS BIGINT)"), "o": (lambda: F.octet_length("s").cast("bigint"), "CAST(strlen(s) AS BIGINT)")})


E("j18_gamma", "part", "p_partkey", {"g": (lambda: N.round_double(P.gamma(c("p_size") / 7 + 0.5), 6), "round(gamma(p_size / 7 + 0.5), 6)"), "l": (lambda: N.round_double(P.lgamma(0.25 - c("p_size")), 6), "round(lgamma(0.25 - p_size), 6)"), "n": (lambda: P.next_after(c("p_retailprice"), c("p_size")), "nextafter(p_retailprice, p_size::DOUBLE)"), "b": (lambda: S.bar(c("p_size"), 0, 50, 20), "bar(p_size, 0, 50, 20)")})
E("j18_signbit", "probe", "id", {"s": (lambda: N.sign_bit(c("d")), "signbit(d)"), "z": (lambda: N.sign_bit(c("d") * 0), "signbit(d * 0)")})


@Q.frame("j23_random", "SELECT count(*) AS n, count(*) AS within, count(DISTINCT o_orderkey) AS ids, true AS even, true AS again, count(*) AS numbers FROM orders")
def random_values(t):
    """Random numbers lie in [0, 1) with a mean near a half and come again with their seed; ids and numbers are distinct."""
    r = t.orders.select("o_orderkey", F.rand().alias("r"), F.rand(5).alias("a"), F.rand(5).alias("b"), F.uuid().alias("u"), F.monotonically_increasing_id().alias("i"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if((c("r") >= 0) & (c("r") < 1)).alias("within"), F.count_distinct("u").alias("ids"), (F.abs(F.avg("r") - 0.5) < 0.1).alias("even"), F.every(c("a") == c("b")).alias("again"), F.count_distinct("i").alias("numbers"))


E("j25_double_to_int", "probe", "id", {"a": (lambda: N.double_to_int(F.when(F.abs("d") < 1e6, c("d"))), "CAST(CASE WHEN abs(d) < 1e6 THEN d END AS INT)"), "b": (lambda: N.double_to_int(c("d"), "bigint"), "CAST(d AS BIGINT)")})
E("j26_decimal_to_int", "probe", "id", {"a": (lambda: N.decimal_to_int(c("n")), "CAST(n AS INT)")})
E("j27_double_to_decimal", "lineitem", "l_orderkey", {"a": (lambda: N.double_to_decimal(c("l_extendedprice") * c("l_discount") / 100, 12, 2), "CAST(l_extendedprice * l_discount / 100 AS DECIMAL(12,2))"), "b": (lambda: N.double_to_decimal(F.lit(0.285), 9, 2), "CAST(0.285::DOUBLE AS DECIMAL(9,2))")})
_TEXTS = ["12", " 12 ", "12.7", "1e3", "abc", "", "2147483648", "-7.5"]
E("j28_try_cast", "region", "r_regionkey", {f"v{i}": ((lambda x=x: N.try_int(F.lit(x))), f"TRY_CAST('{x}' AS INT)") for i, x in enumerate(_TEXTS)} | {"d": (lambda: N.try_date(F.lit("2024-02-30")), "TRY_CAST('2024-02-30' AS DATE)"), "e": (lambda: N.try_date(F.lit("2024-02-29")), "TRY_CAST('2024-02-29' AS DATE)")})
E("j29_number_to_text", "probe", "id", {"d": (lambda: N.double_text(c("d")), "CAST(d AS VARCHAR)"), "n": ("CAST(n AS STRING)", "CAST(n AS VARCHAR)")})
E("j30_to_text", "probe", "id", {"i": ("CAST(i AS STRING)", "CAST(i AS VARCHAR)"), "b": ("CAST(i > 0 AS STRING)", "CAST(i > 0 AS VARCHAR)"), "d": ("CAST(dt AS STRING)", "CAST(dt AS VARCHAR)"), "t": ("CAST(ts AS STRING)", "CAST(ts AS VARCHAR)")})
E("j31_literals", "region", "r_regionkey", {"d": ("DATE '2024-02-29'", "DATE '2024-02-29'"), "t": ("TIMESTAMP_NTZ '2024-02-29 12:30:00'", "TIMESTAMP '2024-02-29 12:30:00'")})
E("j32_wide_literals", "region", "r_regionkey", {"w": ("CAST('12345678901234567890123456789012345678' AS DECIMAL(38,0))", "CAST(12345678901234567890123456789012345678 AS DECIMAL(38,0))")})
E("j33_float_math", "probe", "id", {"f": ("CAST(CAST(d AS FLOAT) / CAST(3 AS FLOAT) AS FLOAT)", "CAST(d AS FLOAT) / CAST(3 AS FLOAT)"), "g": ("CAST(d AS FLOAT) * CAST(1.1 AS FLOAT)", "CAST(d AS FLOAT) * CAST(1.1 AS FLOAT)")})
E("j34_wide_product", "probe", "id", {"p": ("CAST(n * CAST(100.25 AS DECIMAL(10,2)) AS DECIMAL(20,4))", "CAST(n * CAST(100.25 AS DECIMAL(10,2)) AS DECIMAL(20,4))")})

# -- text ------------------------------------------------------------------------------------------------------------
E("k01_concat_operator", "probe", "id", {"a": ("s || '-' || CAST(i AS STRING)", "s || '-' || CAST(i AS VARCHAR)")})
E("k02_concat", "probe", "id", {"a": (lambda: S.concat(c("s"), F.lit("/"), c("i")), "concat(s, '/', i)")})
E("k03_concat_ws", "probe", "id", {"a": ("concat_ws('-', s, CAST(i AS STRING), 'z')", "concat_ws('-', s, i, 'z')")})
E("k04_length", "probe", "id", {"a": (lambda: F.length("s").cast("bigint"), "length(s)")})
E("k05_case", "probe", "id", {"u": ("upper(s)", "upper(s)"), "l": ("lower(s)", "lower(s)")})
E("k06_substring", "probe", "id", {f"v{i}": ((lambda a=a: S.substring(c("s"), *a)), f"substring(s, {', '.join(map(str, a))})") for i, a in enumerate([(2,), (2, 2), (0, 2), (-2,), (-3, 2), (3, -2), (1, 100)])})
E("k07_left_right", "probe", "id", {f"v{i}": ((lambda f=f, n=n: getattr(S, f)(c("s"), n)), f"{f}(s, {n})") for i, (f, n) in enumerate([("left", 2), ("left", -1), ("right", 2), ("right", -1), ("left", 0)])})
E("k08_trim", "probe", "id", {"a": ("trim(s)", "trim(s)"), "b": ("ltrim(s)", "ltrim(s)"), "r": ("rtrim(s)", "rtrim(s)"), "x": ("trim(BOTH 'ac' FROM s)", "trim(s, 'ac')")})
E("k09_pad", "probe", "id", {"a": ("lpad(s, 5, '*')", "lpad(s, 5, '*')"), "b": ("rpad(s, 2, 'xy')", "rpad(s, 2, 'xy')")})
E("k10_replace", "probe", "id", {"a": ("replace(s, 'b', 'BB')", "replace(s, 'b', 'BB')"), "b": ("reverse(s)", "reverse(s)"), "r": ("repeat(s, 2)", "repeat(s, 2)"), "t": ("translate(s, 'abc', 'xyz')", "translate(s, 'abc', 'xyz')")})
E("k11_position", "probe", "id", {"a": (lambda: F.instr("s", "b").cast("bigint"), "CAST(strpos(s, 'b') AS BIGINT)"), "b": ("CAST(position('c' IN s) AS BIGINT)", "CAST(position('c' IN s) AS BIGINT)")})
E("k12_contains", "probe", "id", {"a": ("contains(s, 'b')", "contains(s, 'b')"), "b": ("startswith(s, 'a')", "starts_with(s, 'a')"), "e": ("endswith(s, 'c')", "ends_with(s, 'c')")})
E("k13_split_part", "probe", "id", {"a": ("split_part(s, ',', 2)", "split_part(s, ',', 2)"), "b": ("split_part(s, ',', 9)", "split_part(s, ',', 9)")})
E("k14_string_split", "part", "p_partkey", {"a": (lambda: F.array_join(S.split(c("p_name"), " "), "|"), "array_to_string(string_split(p_name, ' '), '|')"), "n": (lambda: F.size(F.split("p_type", "[AEO]", -1)).cast("bigint"), "len(string_split_regex(p_type, '[AEO]'))")})
E("k15_code_points", "probe", "id", {"u": (lambda: S.unicode(c("s")).cast("bigint"), "CAST(unicode(s) AS BIGINT)"), "c": (lambda: F.chr(F.lit(65) + F.abs("j")), "chr(65 + abs(j))")})
E("k16_regexp_matches", "part", "p_partkey", {"m": ("p_name RLIKE '^(red|blue) .*[td]$'", "regexp_matches(p_name, '^(red|blue) .*[td]$')")})
E("k17_regexp_full_match", "part", "p_partkey", {"m": (lambda: S.regexp_full_match(c("p_name"), "[a-z]+ (ring|bolt)"), "regexp_full_match(p_name, '[a-z]+ (ring|bolt)')")})
E("k18_regexp_extract", "customer", "c_custkey", {"a": (lambda: S.regexp_extract(c("c_name"), r"0*([1-9]\d*)$", 1), r"regexp_extract(c_name, '0*([1-9]\d*)$', 1)"), "b": (lambda: S.regexp_extract(c("c_name"), "xyz"), "regexp_extract(c_name, 'xyz')")})
E("k19_regexp_replace", "part", "p_partkey", {"a": (lambda: S.regexp_replace(c("p_name"), "[aeiou]", "_"), "regexp_replace(p_name, '[aeiou]', '_')"), "b": (lambda: S.regexp_replace(c("p_name"), "[aeiou]", "_", "g"), "regexp_replace(p_name, '[aeiou]', '_', 'g')"), "g": (lambda: S.regexp_replace(c("p_name"), "([a-z]+) ([a-z]+)", r"\2 \1"), r"regexp_replace(p_name, '([a-z]+) ([a-z]+)', '\2 \1')")})
E("k20_regexp_all", "part", "p_partkey", {"a": (lambda: F.array_join(F.regexp_extract_all("p_name", F.lit("[aeiou]"), F.lit(0)), ""), "array_to_string(regexp_extract_all(p_name, '[aeiou]'), '')"), "e": (lambda: S.regexp_escape(c("p_brand")), "regexp_escape(p_brand)")})
_FORMAT = "%Y/%m/%d %H:%M:%S day %j %A %b"
E("k21_strftime", "events", "event_id", {"a": (lambda: S.strftime(c("ts"), _FORMAT), f"strftime(ts, '{_FORMAT}')"), "b": (lambda: S.strftime(c("ts"), "%-d.%-m.%y %I%p"), "strftime(ts, '%-d.%-m.%y %I%p')")})
E("k22_format", "nation", "n_nationkey", {"a": (lambda: S.format_braces("{}: {}!", c("n_name"), c("n_regionkey")), "format('{}: {}!', n_name, n_regionkey)"), "p": (lambda: F.format_string("%s has %d", c("n_name"), c("n_regionkey")), "printf('%s has %d', n_name, n_regionkey)")})
E("k23_digests", "part", "p_partkey", {"m": ("md5(p_name)", "md5(p_name)"), "s": ("sha2(p_name, 256)", "sha256(p_name)"), "o": ("sha1(p_brand)", "sha1(p_brand)")})
E("k25_encodings", "part", "p_partkey", {"h": ("hex(p_name)", "hex(p_name)"), "b": ("base64(CAST(p_name AS BINARY))", "base64(encode(p_name))"), "n": ("bin(p_partkey)", "bin(p_partkey)"), "u": (lambda: S.url_encode(c("p_name")), "url_encode(p_name)"), "d": ("url_decode('a%20b')", "url_decode('a%20b')")})
E("k26_similarity", "part", "p_partkey", {"l": (lambda: F.levenshtein("p_name", "p_type").cast("bigint"), "levenshtein(p_name, p_type)"), "j": (lambda: S.jaccard(c("p_name"), c("p_type")), "jaccard(p_name, p_type)"), "h": (lambda: S.hamming(F.lpad("p_name", 12, "-"), F.lpad("p_brand", 12, "-")), "hamming(lpad(p_name, 12, '-'), lpad(p_brand, 12, '-'))")})
E("k27_misc_text", "probe", "id", {"a": (lambda: S.strip_accents(c("s")), "strip_accents(s)"), "f": (lambda: S.file_name(F.concat(F.lit("/x/y/"), c("id").cast("string"), F.lit(".csv"))), "parse_filename('/x/y/' || id || '.csv')"), "b": (lambda: S.format_bytes(c("id").cast("bigint") * 700), "format_bytes(id * 700)")})
E("k28_like_escape", "probe", "id", {"a": ("concat(s, '%') LIKE '%!%' ESCAPE '!'", "(s || '%') LIKE '%!%' ESCAPE '!'")})


@Q.frame("l01_clock")
def clock(t):
    return t.region.select("r_regionkey", F.current_date().alias("d"), F.localtimestamp().alias("ts"))


# -- dates and times -----------------------------------------------------------------------------------------------
_TS = ("ts", "ts")
E("l02_date_plus_days", "probe", "id", {"a": ("date_add(dt, 3)", "dt + 3"), "b": ("date_sub(dt, 40)", "dt - 40")})
E("l03_date_minus_date", "probe", "id", {"a": (lambda: D.date_minus_date(c("dt"), F.lit("2024-01-01").cast("date")), "dt - DATE '2024-01-01'")})
_IV = ["1 month", "-1 month", "1 year 2 days", "90 minutes", "2 weeks", "1 month 1 day 1 hour", "36 hours"]
E("l04_interval_addition", "probe", "id", {f"v{i}": ((lambda x=x: D.add_interval(c("ts"), x)), f"ts + INTERVAL '{x}'") for i, x in enumerate(_IV)} | {"d": (lambda: D.add_interval(c("dt"), "1 month"), "dt + INTERVAL 1 MONTH")})
_PARSED = ["1 year 3 months", "2 days 03:04:05", "1 decade 1 quarter", "-1 hour 30 minutes"]
E("l05_interval_text", "region", "r_regionkey", {f"v{i}": ((lambda x=x: D.add_interval(F.lit("2024-01-31").cast("date"), x)), f"DATE '2024-01-31' + INTERVAL '{x}'") for i, x in enumerate(_PARSED)})
E("l06_interval_functions", "probe", "id", {"a": (lambda: D.from_micros(D.micros(c("ts")) + c("j").cast("bigint") * D.DAY_US), "ts + to_days(j)"), "m": (lambda: c("ts") + F.make_ym_interval(F.lit(0), c("j")), "ts + to_months(j)"), "h": (lambda: D.from_micros(D.micros(c("ts")) + c("j").cast("bigint") * 3_600_000_000), "ts + to_hours(j)")})
_TRUNC = ["year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond", "decade", "century", "millennium"]
E("l07_date_trunc", "events", "event_id", {u: ((lambda u=u: D.date_trunc(u, c("ts"))), f"CAST(date_trunc('{u}', ts) AS TIMESTAMP)") for u in _TRUNC})
_PARTS = ["year", "month", "day", "quarter", "hour", "minute", "second", "millisecond", "microsecond", "doy", "dow", "isodow", "week", "isoyear", "yearweek", "decade", "century", "millennium", "era"]
E("l08_date_part", "events", "event_id", {f"p_{u}": ((lambda u=u: D.date_part(u, c("ts"))), f"CAST(date_part('{u}', ts) AS BIGINT)") for u in _PARTS})
E("l09_parts_of_dates", "orders", "o_orderkey", {f"p_{u}": ((lambda u=u: D.date_part(u, c("o_orderdate"))), f"CAST({u}(o_orderdate) AS BIGINT)") for u in ("year", "month", "day", "quarter", "hour", "minute")})
E("l10_weekdays", "orders", "o_orderkey", {u: ((lambda u=u: D.date_part(u, c("o_orderdate"))), f"CAST({f}(o_orderdate) AS BIGINT)") for u, f in (("dow", "dayofweek"), ("isodow", "isodow"))})
E("l11_iso_weeks", "orders", "o_orderkey", {"w": (lambda: D.date_part("week", c("o_orderdate")), "CAST(weekofyear(o_orderdate) AS BIGINT)"), "y": (lambda: D.date_part("isoyear", c("o_orderdate")), "CAST(isoyear(o_orderdate) AS BIGINT)"), "yw": (lambda: D.date_part("yearweek", c("o_orderdate")), "CAST(yearweek(o_orderdate) AS BIGINT)")})
E("l12_epoch_julian", "probe", "id", {"e": (lambda: D.date_part("epoch", c("ts")), "CAST(epoch(ts) AS DOUBLE)"), "j": (lambda: N.round_double(D.date_part("julian", c("ts")), 6), "round(julian(ts), 6)")})
_DIFF = ["year", "quarter", "month", "week", "day", "hour", "minute", "second", "decade", "century"]
E("l13_date_diff", "orders", "o_orderkey", {f"d_{u}": ((lambda u=u: D.date_diff(u, F.lit("1998-02-14 13:45:30").cast("timestamp_ntz"), c("o_orderdate"))), f"date_diff('{u}', TIMESTAMP '1998-02-14 13:45:30', o_orderdate)") for u in _DIFF})
E("l14_date_sub", "orders", "o_orderkey", {u.lower(): ((lambda u=u: D.date_sub(u, F.lit("1998-02-14 13:45:30").cast("timestamp_ntz"), c("o_orderdate"))), f"date_sub('{u.lower()}', TIMESTAMP '1998-02-14 13:45:30', o_orderdate)") for u in ("MONTH", "DAY", "HOUR")})
_AGE = "age(o_orderdate, TIMESTAMP '1996-05-20 08:00:00')"
_age = lambda: D.age_parts(c("o_orderdate"), F.lit("1996-05-20 08:00:00").cast("timestamp_ntz"))
E("l15_age", "orders", "o_orderkey", {"y": (lambda: F.call_function("div", _age()["months"], F.lit(12)).cast("bigint"), f"date_part('year', {_AGE})"), "m": (lambda: (_age()["months"] % 12).cast("bigint"), f"date_part('month', {_AGE})"), "d": (lambda: _age()["days"], f"date_part('day', {_AGE})"), "h": (lambda: F.call_function("div", _age()["micros"], F.lit(3_600_000_000)).cast("bigint"), f"date_part('hour', {_AGE})")})
E("l16_normalized_interval", "region", "r_regionkey", {f"v{i}": ((lambda x=x: F.lit(D.normalized_micros(D.Interval.parse(x)) / 86_400_000_000)), f"CAST(epoch(INTERVAL '{x}') AS DOUBLE) / 86400") for i, x in enumerate(["1 month", "2 days 12:00:00", "6 hours"])})
E("l17_make", "orders", "o_orderkey", {"l": (lambda: F.last_day("o_orderdate"), "last_day(o_orderdate)"), "m": (lambda: F.make_date(F.year("o_orderdate"), F.lit(2), F.lit(28)), "make_date(year(o_orderdate), 2, 28)"), "t": (lambda: F.make_timestamp_ntz(F.year("o_orderdate"), F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(5.5)), "make_timestamp(year(o_orderdate), 1, 2, 3, 4, 5.5)")})
E("l18_names", "orders", "o_orderkey", {"d": (lambda: D.day_name(c("o_orderdate")), "dayname(o_orderdate)"), "m": (lambda: D.month_name(c("o_orderdate")), "monthname(o_orderdate)")})
E("l19_strptime_buckets", "events", "event_id", {"p": (lambda: S.strptime(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), "%d/%m/%Y %H:%M:%S"), "strptime(strftime(ts, '%d/%m/%Y %H:%M:%S'), '%d/%m/%Y %H:%M:%S')"), "t": (lambda: S.strptime(F.concat(F.lit("x"), c("event_type")), "%d/%m/%Y", strict=False), "try_strptime('x' || event_type, '%d/%m/%Y')"), "b": (lambda: D.time_bucket("15 minutes", c("ts")), "time_bucket(INTERVAL '15 minutes', ts)"), "w": (lambda: D.time_bucket("7 days", c("ts")), "time_bucket(INTERVAL '7 days', ts)"), "m": (lambda: D.time_bucket("2 months", c("ts")), "CAST(time_bucket(INTERVAL '2 months', ts) AS TIMESTAMP)"), "e": (lambda: F.floor((D.micros(c("ts")) + 500) / 1000).cast("bigint"), "epoch_ms(ts)")})

# -- JSON and nested -----------------------------------------------------------------------------------------------
_DOC = '{"a": {"b": [1, {"c": "x y"}]}, "n": null, "t": true, "f": 1.5, "s": "q"}'
_PATHS = ["$.a.b[0]", "$.a.b[1].c", "$.t", "$.f", "$.s", "$.none"]
E("m01_json_extract_string", "events", "event_id", {"k": (lambda: F.get_json_object("props", "$.k"), "json_extract_string(props, '$.k')")} | {f"v{i}": ((lambda p=p: F.get_json_object(F.lit(_DOC), p)), f"json_extract_string('{_DOC}', '{p}')") for i, p in enumerate(_PATHS)})
E("m02_json_extract", "events", "event_id", {"k": (lambda: J.json_extract(c("props"), "$.k"), "CAST(json_extract(props, '$.k') AS VARCHAR)"), "s": (lambda: J.json_extract(F.lit(_DOC), "$.s"), f"CAST(json_extract('{_DOC}', '$.s') AS VARCHAR)")})
E("m03_json_array_length", "region", "r_regionkey", {"n": (lambda: J.json_array_length(F.lit("[1, [2, 3], {}]")), "CAST(json_array_length('[1, [2, 3], {}]') AS BIGINT)")})
E("m04_json_valid_keys", "events", "event_id", {"v": (lambda: J.json_valid(c("props")), "json_valid(props)"), "w": (lambda: J.json_valid(F.concat(c("props"), F.lit("}"))), "json_valid(props || '}')"), "k": (lambda: F.array_join(J.json_keys(c("props")), ","), "array_to_string(json_keys(props), ',')")})
E("m05_list_functions", "embeddings", "vec_id", {"n": (lambda: F.size("embedding").cast("bigint"), "CAST(len(embedding) AS BIGINT)"), "e": (lambda: F.element_at("embedding", 2), "embedding[2]"), "top": (lambda: F.array_max("embedding"), "list_max(embedding)"), "lo": (lambda: F.element_at(F.array_sort("embedding"), 1), "list_sort(embedding)[1]"), "sl": (lambda: F.element_at(J.list_slice(c("embedding"), 3, 6), -1), "embedding[3:6][-1]"), "has": (lambda: F.array_contains("embedding", F.element_at("embedding", 1)), "list_contains(embedding, embedding[1])"), "pos": (lambda: F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint"), "CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT)"), "tr": (lambda: N.round_double(F.element_at(F.transform("embedding", lambda x: x.cast("double") * 2), 3), 9), "round(list_transform(embedding, lambda x: x::DOUBLE * 2)[3], 9)"), "su": (lambda: N.round_double(J.list_sum(c("embedding")), 6), "round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6)")})
Q.sql("m05_list_values", "SELECT array_join(array_sort(array_distinct(array(3, 1, 3, 2))), ',') AS d, array_join(concat(array(1), array(2, 3)), ',') AS c, aggregate(array(1, 2, 3), 0, (a, x) -> a + x) AS r", "SELECT array_to_string(list_sort(list_distinct([3, 1, 3, 2])), ',') AS d, array_to_string([1] || [2, 3], ',') AS c, list_reduce([1, 2, 3], lambda a, x: a + x) AS r")


@Q.frame("m05_vector_search", "WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q, vec_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS sim FROM q, embeddings WHERE vec_id <> q) SELECT q, vec_id, sim FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) <= 3")
def vector_search(t):
    """Each query vector (every twentieth) against all rows: a stated query set, sent to all rows in blocks."""
    from ..operators import joins, shapes

    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"))
    pairs = t.embeddings.crossJoin(joins.small_side(q)).where("vec_id <> q").select("q", "vec_id", N.round_double(J.cosine_similarity(c("e"), c("embedding")), 6).alias("sim"))
    return shapes.top_per_group(pairs, ["q"], ["-sim", "vec_id"], 3)


Q.sql("m06_structs", "SELECT n_nationkey, named_struct('a', n_name, 'b', n_regionkey).a AS a, struct(n_regionkey, n_name).n_regionkey AS r FROM nation", "SELECT n_nationkey, struct_pack(a := n_name, b := n_regionkey).a AS a, row(n_regionkey, n_name)[1] AS r FROM nation")
Q.sql("m07_maps", "SELECT n_nationkey, map('k', n_name, 'r', CAST(n_regionkey AS STRING))['r'] AS r, CAST(size(map_keys(map('k', 1, 'r', 2))) AS BIGINT) AS n, array_join(map_values(map('a', 1, 'b', 2)), ',') AS v FROM nation", "SELECT n_nationkey, map {'k': n_name, 'r': CAST(n_regionkey AS VARCHAR)}['r'] AS r, len(map_keys(map {'k': 1, 'r': 2})) AS n, array_to_string(map_values(map {'a': 1, 'b': 2}), ',') AS v FROM nation")
Q.sql("m08_unnest_flatten", "SELECT n_nationkey, x FROM nation LATERAL VIEW explode(flatten(array(array(n_regionkey, 1), array(n_nationkey)))) e AS x", "SELECT n_nationkey, unnest(flatten([[n_regionkey, 1], [n_nationkey]])) AS x FROM nation")
Q.sql("m09_json_each", "SELECT event_id, k, v FROM events LATERAL VIEW explode(from_json(props, 'map<string,string>')) e AS k, v", "SELECT event_id, key AS k, CAST(json_each.value AS VARCHAR) AS v FROM events, json_each(props)")
E("m05_distances", "embeddings", "vec_id", {"d": (lambda: N.round_double(J.distance(c("embedding"), F.reverse("embedding")), 6), "round(list_distance(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6)"), "p": (lambda: N.round_double(J.dot(c("embedding"), F.reverse("embedding")), 6), "round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6)"), "c": (lambda: N.round_double(J.cosine_similarity(c("embedding"), F.reverse("embedding")), 6), "round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6)")})
E("k25_to_base", "part", "p_partkey", {"h": (lambda: S.to_base(c("p_partkey"), 16), "to_base(p_partkey, 16)"), "b": (lambda: S.to_base(c("p_size"), 2, 8), "to_base(p_size, 2, 8)"), "z": (lambda: S.to_base(c("p_partkey") * 12345, 36), "to_base(p_partkey * 12345, 36)")})
E("k26_jaro_damerau", "part", "p_partkey", {"j": (lambda: N.round_double(P.jaro(c("p_name"), c("p_type")), 9), "round(jaro_similarity(p_name, p_type), 9)"), "w": (lambda: N.round_double(P.jaro_winkler(c("p_name"), F.lower("p_type")), 9), "round(jaro_winkler_similarity(p_name, lower(p_type)), 9)"), "v": (lambda: N.round_double(P.jaro_winkler(c("p_name"), F.reverse("p_name")), 9), "round(jaro_winkler_similarity(p_name, reverse(p_name)), 9)"), "d": (lambda: P.damerau_levenshtein(c("p_name"), F.reverse("p_name")), "damerau_levenshtein(p_name, reverse(p_name))"), "e": (lambda: P.damerau_levenshtein(c("p_name"), F.lower("p_type")), "damerau_levenshtein(p_name, lower(p_type))")})
E("k27_unicode_paths", "part", "p_partkey", {"n": (lambda: P.nfc_normalize(F.concat("p_name", F.lit("e\u0301"))), "nfc_normalize(p_name || 'e\u0301')"), "g": (lambda: S.length_grapheme(F.concat("p_name", F.lit("e\u0301😀"))), "length_grapheme(p_name || 'e\u0301😀')"), "l": (lambda: S.left_grapheme(F.concat(F.lit("e\u0301"), c("p_name")), 3), "left_grapheme('e\u0301' || p_name, 3)"), "s": (lambda: F.octet_length(F.concat("p_name", F.lit("é"))).cast("bigint"), "strlen(p_name || 'é')"), "p": (lambda: F.array_join(S.parse_path(F.concat(F.lit("/x/"), c("p_name"), F.lit("/"), c("p_type"))), "|"), "array_to_string(parse_path('/x/' || p_name || '/' || p_type), '|')"), "d": (lambda: S.dir_name(F.concat(F.lit("x/y/"), c("p_name"))), "parse_dirname('x/y/' || p_name)"), "t": (lambda: S.dir_path(F.concat(F.lit("x/y/"), c("p_name"))), "parse_dirpath('x/y/' || p_name)")})
E("l19_epochs_zones", "events", "event_id", {"u": (lambda: D.micros(c("ts")), "epoch_us(ts)"), "n": (lambda: D.micros(c("ts")) * 1000, "epoch_ns(ts)"), "t": (lambda: F.timestamp_seconds(c("event_id") * 1000).cast("timestamp_ntz"), "CAST(to_timestamp(event_id * 1000) AT TIME ZONE 'UTC' AS TIMESTAMP)"), "z": (lambda: F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), c("ts")), "timezone('UTC', timezone('America/New_York', ts))"), "k": (lambda: F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), c("ts")), "timezone('Asia/Kolkata', timezone('UTC', ts))")})
_JSON = ["concat('{\"a\":', p_size - 20, ',\"b\":[', p_partkey, ',1.5,null],\"c\":{\"n\":\"', p_name, '\",\"x\":null}}')"] * 2
E("m04_json_inspection", "part", "p_partkey", {
    "t": (lambda: P.json_type(F.get_json_object(F.expr(_JSON[0]), "$.a")), f"json_type({_JSON[1]}, '$.a')"), "o": (lambda: P.json_type(F.expr(_JSON[0])), f"json_type({_JSON[1]})"),
    "e": (lambda: J.json_exists(F.expr(_JSON[0]), "$.c.x"), f"json_exists({_JSON[1]}, '$.c.x')"), "m": (lambda: J.json_exists(F.expr(_JSON[0]), "$.c.y"), f"json_exists({_JSON[1]}, '$.c.y')"),
    "i": (lambda: P.json_contains(F.expr(_JSON[0]), F.expr("concat('{\"b\":[', p_partkey, ']}')")), f"json_contains({_JSON[1]}, concat('{{\"b\":[', p_partkey, ']}}'))"), "j": (lambda: P.json_contains(F.expr(_JSON[0]), F.lit("7")), f"json_contains({_JSON[1]}, '7')"),
    "p": (lambda: P.json_merge_patch(F.expr(_JSON[0]), F.lit('{"a":null,"c":{"x":2}}')), f"CAST(json_merge_patch({_JSON[1]}, '{{\"a\":null,\"c\":{{\"x\":2}}}}') AS VARCHAR)"),
    "s": (lambda: P.json_structure(F.expr(_JSON[0])), f"CAST(json_structure({_JSON[1]}) AS VARCHAR)"), "y": (lambda: P.json_pretty(F.expr(_JSON[0])), f"CAST(json_pretty({_JSON[1]}) AS VARCHAR)"),
    "f": (lambda: F.from_json(F.expr(_JSON[0]), "a int, c struct<n string>")["c"]["n"], f"json_transform({_JSON[1]}, '{{\"a\":\"INTEGER\",\"c\":{{\"n\":\"VARCHAR\"}}}}').c.n"),
    "b": (lambda: F.to_json(F.struct(c("p_partkey").alias("k"), c("p_name").alias("v"))), "CAST(json_object('k', p_partkey, 'v', p_name) AS VARCHAR)"), "r": (lambda: F.to_json(F.array("p_name", "p_type")), "CAST(json_array(p_name, p_type) AS VARCHAR)"),
})


@Q.frame("m04_json_groups", "SELECT n_regionkey, CAST(json_group_array(n_name) AS VARCHAR) AS a, CAST(json_group_object(n_name, n_nationkey) AS VARCHAR) AS o FROM (SELECT * FROM nation ORDER BY n_name) GROUP BY n_regionkey")
def json_groups(t):
    return t.nation.groupBy("n_regionkey").agg(J.json_group_array(c("n_name"), c("n_name")).alias("a"), J.json_group_object(c("n_name"), c("n_nationkey")).alias("o"))


@Q.frame("m07_map_extract", "SELECT n_nationkey, map_extract(map {n_name: CAST(n_regionkey AS VARCHAR)}, 'NATION_1')[1] AS v, CAST(len(map_extract(map {n_name: CAST(n_regionkey AS VARCHAR)}, 'NATION_1')) AS BIGINT) AS n FROM nation")
def extracted(t):
    found = J.map_extract(F.create_map(c("n_name"), c("n_regionkey").cast("string")), F.lit("NATION_1"))
    return t.nation.select("n_nationkey", F.get(found, 0).alias("v"), F.size(found).cast("bigint").alias("n"))


@Q.frame("m08_subscripts", "SELECT vec_id, generate_subscripts(embedding, 1) AS i FROM embeddings")
def subscripts(t):
    return t.embeddings.select("vec_id", F.explode(J.subscripts(c("embedding")).cast("array<bigint>")).alias("i"))


@Q.frame("m08_list_zip", "SELECT vec_id, p.a AS a, p.b AS b FROM (SELECT vec_id, unnest(list_transform(list_zip(embedding, embedding[2:]), lambda z: {'a': z[1], 'b': z[2]})) AS p FROM embeddings)")
def zipped(t):
    return t.embeddings.select("vec_id", F.explode(F.arrays_zip(c("embedding").alias("a"), F.slice("embedding", 2, F.size("embedding")).alias("b"))).alias("p")).select("vec_id", c("p.a").alias("a"), c("p.b").alias("b"))


@Q.frame("m09_json_tree", f"SELECT p_partkey, t.key AS k, CAST(t.value AS VARCHAR) AS v, t.type AS type, CAST(t.atom AS VARCHAR) AS atom, t.fullkey AS fullkey, t.path AS path FROM part, json_tree({_JSON[1]}) AS t")
def tree(t):
    e = t.part.select("p_partkey", F.explode(P.json_tree(F.expr(_JSON[0]))).alias("e"))
    return e.select("p_partkey", c("e.key").alias("k"), c("e.value").alias("v"), "e.type", "e.atom", "e.fullkey", "e.path")
