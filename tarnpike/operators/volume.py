"""Volume and spread of bars: surprises against the same time of day, signed shares, illiquidity, spread estimates.

Bars are (symbol, ts, open, high, low, close, volume, mid). A bar without volume and a spread that is not positive are unknown, never 0. Returns are
null across gaps (``masked_returns``). Unless said otherwise a window of w rows needs three quarters of them, two at least.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnpike.functions.safe import before_n, framed, last_n, max_n, mean_n, min_n, ordered, sdiv, sln, std_n, sum_n, zscore_before
from tarnpike.operators.sequences import local_slot, masked_returns, slot_z

#: kinds of members and how many numbers follow the name
MEMBERS = {
    "vz": 1, "vz_ma": 2, "vimb": 1, "vimb_chg": 2, "vimb_z": 2, "vconf": 2, "vpdiv": 1, "vwret": 2, "vrange_imb": 1, "amihud_z": 2, "amihud_chg": 2,
    "sz": 1, "sz_ma": 2, "sexp": 2, "spread_ratio": 2, "sconf": 2, "roll_z": 2, "break_vol": 2, "jump_vol": 2,
}


def member(name: str) -> tuple[str, list[int]]:
    """Kind and numbers of a member's name. Other names raise."""
    found = re.fullmatch(r"([a-z_]+?)((?:_\d+)+)", name)
    kind, numbers = (found[1], [int(x) for x in found[2][1:].split("_")]) if found else (name, [])
    if MEMBERS.get(kind) != len(numbers):
        raise ValueError(f"{name} is no volume or spread member")
    return kind, numbers


def least(w: int) -> int:
    return max(2, round(0.75 * w))


def volume_members(bars: DataFrame, names: list[str], pip: float = 0.0001, deviation: int = 1920, jump: float = 2.0, breaks: int = 4) -> DataFrame:
    """Bars with the named members (see MEMBERS), each from data up to the bar's close.

    vz_n, sz_n: log volume and log spread against the same London time of day, in deviations of the n bars there before; vz_ma_k_n, sz_ma_k_n: their means over k.
    vimb_w: volume signed by return over volume; vimb_chg_w_k, vimb_z_w_z: its change and z. vconf_k_n, sconf_k_n: the k-bar move in deviations
    (of ``deviation`` bars, one bar back) times vz_ma, sz_ma. vpdiv_w: vimb less the sum of returns over the sum of their sizes. vwret_w_z: volume-weighted less plain mean
    return, in deviations of z bars one bar back. vrange_imb_w: volume in the upper less that in the lower quarter of the w-bar channel over all.
    amihud_z_w_z, amihud_chg_w_k: of the log mean of return size over volume. sexp_k_w, spread_ratio_w_z: mean spread of the first number over that of the second, less 1.
    roll_z_w_z: z of 2 sqrt(-cov) of price changes and the ones before, in pips. break_vol_w_n: direction of a close beyond the w bars before times the mean vz of ``breaks`` bars,
    0 without; jump_vol_w_n: sign of a return beyond ``jump`` deviations (w bars, one bar back) times vz, 0 without.
    """
    w_ = ordered("symbol")
    spread = 2 * (F.col("close") - F.col("mid")) / pip
    x = masked_returns(bars).withColumns({"_v": F.when(F.col("volume") > 0, F.col("volume").cast("double")), "_s": F.when(spread > 0, spread)})
    x = x.withColumns({"_lv": sln(F.col("_v")), "_ls": sln(F.col("_s")), "_valid": F.col("r").isNotNull() & F.col("_v").isNotNull()})

    def put(name: str, value: Column) -> Column:
        nonlocal x
        if name not in x.columns:
            x = x.withColumn(name, value)
        return F.col(name)

    def z(name: str, n: int) -> Column:
        nonlocal x
        out = f"_{name}_{n}"
        if out not in x.columns:
            x = slot_z(x, f"_l{name}", n, out, local_slot("Europe/London"))
        return F.col(out)

    def z_mean(name: str, k: int, n: int) -> Column:
        return put(f"_{name}ma_{k}_{n}", mean_n(z(name, n), w_, k, least(k)))

    def deviation_before(n: int) -> Column:
        put(f"_sd_{n}", std_n("r", w_, n, least(n)))
        return put(f"_sd1_{n}", F.lag(f"_sd_{n}").over(w_))

    def move(k: int) -> Column:
        sd = deviation_before(deviation)
        return put(f"_move_{k}", sdiv(sum_n("r", w_, k, least(k)), sd * math.sqrt(k)))

    def valid(c: Column) -> Column:
        return F.when(F.col("_valid"), c)

    def signed(n: int) -> Column:
        share = sdiv(sum_n(valid(F.signum("r") * F.col("_v")), w_, n, least(n)), sum_n(valid(F.col("_v")), w_, n, least(n)))
        return put(f"_vimb_{n}", share)

    def illiquidity(n: int) -> Column:
        return put(f"_amihud_{n}", sln(mean_n(valid(F.abs("r") / F.col("_v")), w_, n, least(n))))

    def ratio(a: int, b: int) -> Column:
        return sdiv(mean_n("_s", w_, a, least(a)), mean_n("_s", w_, b, least(b))) - 1

    def roll(n: int) -> Column:
        put("_d", F.when(F.col("r").isNotNull(), F.col("close") - F.lag("close").over(w_)))
        put("_d1", F.when(F.col("_d").isNotNull(), F.lag("_d").over(w_)))
        put("_d0", F.when(F.col("_d1").isNotNull(), F.col("_d")))
        f = last_n(w_, n)
        mean = lambda c: F.avg(c).over(f)
        cov = F.when(F.count("_d0").over(f) >= least(n), mean(F.col("_d0") * F.col("_d1")) - mean(F.col("_d0")) * mean(F.col("_d1")))
        return put(f"_roll_{n}", 2 * F.sqrt(F.greatest(-cov, F.lit(0.0))) / pip)

    def outer(n: int) -> Column:
        low, high = put(f"_low_{n}", min_n("low", w_, n, least(n))), put(f"_high_{n}", max_n("high", w_, n, least(n)))
        place = put(f"_place_{n}", F.when(high > low, (F.col("close") - low) / (high - low)))
        known = place.isNotNull() & F.col("_v").isNotNull()
        side = F.when(place >= 0.75, 1.0).when(place <= 0.25, -1.0).otherwise(0.0)
        return sdiv(sum_n(F.when(known, side * F.col("_v")), w_, n, least(n)), sum_n(F.when(known, F.col("_v")), w_, n, least(n)))

    def broken(n: int, m: int) -> Column:
        before = before_n(w_, n)
        high, low = put(f"_bh_{n}", framed(F.max("high"), F.col("high"), before, n)), put(f"_bl_{n}", framed(F.min("low"), F.col("low"), before, n))
        of = max(2, breaks)
        surprise = put(f"_bz_{m}", mean_n(z("v", m), w_, of, max(2, of - 1)))
        c = F.col("close")
        known = high.isNotNull() & low.isNotNull() & surprise.isNotNull() & c.isNotNull()
        return F.when(known, F.when(c > high, surprise).when(c < low, -surprise).otherwise(0.0))

    def jumped(n: int, m: int) -> Column:
        sd, surprise, r = deviation_before(n), z("v", m), F.col("r")
        known = r.isNotNull() & (sd > 0) & surprise.isNotNull()
        return F.when(known, F.when(F.abs(r) > jump * sd, F.signum(r) * surprise).otherwise(0.0))

    def path(n: int) -> Column:
        return signed(n) - sdiv(sum_n("r", w_, n, least(n)), sum_n(F.abs("r"), w_, n, least(n)))

    def weighted(n: int, m: int) -> Column:
        sd = deviation_before(m)
        by_volume = sdiv(sum_n(valid(F.col("_v") * F.col("r")), w_, n, least(n)), sum_n(valid(F.col("_v")), w_, n, least(n)))
        return sdiv(by_volume - mean_n(valid(F.col("r")), w_, n, least(n)), sd)

    change = lambda c, k: c - F.lag(c, k).over(w_)
    kinds = {
        "vz": lambda n: z("v", n), "sz": lambda n: z("s", n), "vz_ma": lambda k, n: z_mean("v", k, n), "sz_ma": lambda k, n: z_mean("s", k, n),
        "vimb": signed, "vimb_chg": lambda n, k: change(signed(n), k), "vimb_z": lambda n, m: zscore_before(signed(n), w_, m),
        "vconf": lambda k, n: move(k) * z_mean("v", k, n), "sconf": lambda k, n: move(k) * z_mean("s", k, n), "vpdiv": path, "vwret": weighted, "vrange_imb": outer,
        "amihud_z": lambda n, m: zscore_before(illiquidity(n), w_, m), "amihud_chg": lambda n, k: change(illiquidity(n), k), "sexp": ratio, "spread_ratio": ratio,
        "roll_z": lambda n, m: zscore_before(roll(n), w_, m), "break_vol": broken, "jump_vol": jumped,
    }
    for name in names:
        kind, numbers = member(name)
        put(name, kinds[kind](*numbers))
    return x.select(*bars.columns, *names)


def day_shares(bars: DataFrame, n: int) -> DataFrame:
    """vshare_ldn_n, vshare_asia_n: the volume share of 08 to 17 London time and of 00 to 07 UTC on the symbol's day before (UTC), less its mean over the n days
    before that, of which half, and five at least, must be known."""
    a, slot = F.when(F.col("volume") > 0, F.col("volume").cast("double")), local_slot("Europe/London")
    inside = {"vshare_ldn": (slot >= 8 * 60) & (slot < 17 * 60), "vshare_asia": F.hour("ts") < 7}
    total = F.nullif(F.sum(a), F.lit(0.0))
    days = bars.groupBy("symbol", F.to_date("ts").alias("_day")).agg(*((F.sum(F.when(on, a)) / total).alias(f"_{name}") for name, on in inside.items()))
    w = ordered("symbol", by="_day")
    base = w.rowsBetween(-(n + 1), -2)
    score = lambda c: F.lag(c).over(w) - framed(F.avg(c), F.col(c), base, min(n, max(5, n // 2)))
    found = days.select("symbol", "_day", *(score(f"_{name}").alias(f"{name}_{n}") for name in inside))
    return bars.withColumn("_day", F.to_date("ts")).join(found, ["symbol", "_day"], "left").drop("_day")
