"""Twenty-five price and volume features per ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import by_date, ret, roll, running, with_ewm
from ..plans.registry import TECHNICAL
from ..schema import require


def span(n: int) -> float:
    return 2 / (n + 1)


def technical(bars: DataFrame) -> DataFrame:
    """``bars`` with the technical features; adj_close is the price, volume counts as double.

    macd_signal and macd_histogram are the same number by definition.  RSI is 100 where there was no loss.
    """
    require(bars, "ticker", "date", "adj_close", "high", "low", "volume")
    w, c, v = by_date(), F.col("adj_close"), F.col("volume").cast("double")
    keep = bars.columns
    change = c - F.lag(c).over(w)
    df = bars.withColumns(
        {
            "_gain": F.greatest(change, F.lit(0.0)) + change * 0,
            "_loss": F.greatest(-change, F.lit(0.0)) + change * 0,
            "_flow": F.signum(change) * v,
            "_n": F.row_number().over(w),
        }
    )
    df = with_ewm(
        df,
        {
            "_gain14": ("_gain", 1 / 14, 14), "_loss14": ("_loss", 1 / 14, 14),
            "_gain28": ("_gain", 1 / 28, 28), "_loss28": ("_loss", 1 / 28, 28),
            "_ema12": ("adj_close", span(12), 12), "_ema26": ("adj_close", span(26), 26),
        },
    )
    df = df.withColumn("_macd", F.col("_ema12") - F.col("_ema26")).withColumn("_obv", F.when(F.col("_flow").isNotNull(), F.sum("_flow").over(running(w))))
    df = with_ewm(df, {"_signal": ("_macd", span(9), 9)})
    mean = {k: roll(F.avg, c, k, w) for k in (5, 20, 21, 50, 63, 200)}
    df = df.withColumns({f"_sma{k}": m for k, m in mean.items()} | {f"_sd{k}": roll(F.stddev_samp, c, k, w) for k in (20, 21)})
    sma = {k: F.col(f"_sma{k}") for k in mean}

    def rsi(p: int):
        gain, loss = F.col(f"_gain{p}"), F.col(f"_loss{p}")
        value = F.when(loss > 0, 100 - 100 / (1 + F.try_divide(gain, loss))).otherwise(F.lit(100.0))
        return F.when(F.col("_n") > p, value)

    typical = (F.col("high") + F.col("low") + c) / 3
    vwap = F.try_divide(roll(F.sum, typical * v, 21, w), roll(F.sum, v, 21, w))
    frame = w.rowsBetween(-13, 0)
    slope = F.when(F.count("_obv").over(frame) == 14, F.regr_slope("_obv", F.col("_n").cast("double")).over(frame))
    macd = F.col("_macd") - F.col("_signal")
    made = {f"returns_{n}d": ret(c, n, w) for n in (1, 5, 21, 63)}
    made |= {"rsi_14": rsi(14), "rsi_28": rsi(28), "macd_signal": macd, "macd_histogram": macd}
    made |= {"momentum_12_1": ret(c, 252, w) - ret(c, 21, w)}
    made |= {f"mean_reversion_{k}d": F.try_divide(c - sma[k], sma[k]) for k in (5, 21)}
    made |= {f"bollinger_{side}_dist": F.try_divide(c - (sma[20] + k * F.col("_sd20")), F.col("_sd20")) for side, k in (("upper", 2), ("lower", -2))}
    made |= {"z_score_21d": F.try_divide(c - sma[21], F.col("_sd21"))}
    made |= {f"sma_ratio_{a}_{b}": F.try_divide(sma[a], sma[b]) for a, b in ((5, 21), (21, 63))}
    made |= {"ema_ratio_12_26": F.try_divide("_ema12", "_ema26")}
    made |= {f"price_to_sma_{k}": F.try_divide(c, sma[k]) for k in (50, 200)}
    made |= {"golden_cross": (sma[50] > sma[200]).cast("double"), "death_cross": (sma[50] < sma[200]).cast("double")}
    made |= {f"volume_ratio_{k}d": F.try_divide(v, roll(F.avg, v, k, w)) for k in (5, 21)}
    made |= {"obv_slope_14d": slope, "vwap_distance": F.try_divide(c - vwap, vwap)}
    return df.select(*keep, *(made[name].alias(name) for name in TECHNICAL))
