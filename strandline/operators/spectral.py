"""Power spectra and spectrograms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import fx
from strandline.operators.stats import sample_rate
from strandline.plans.layout import ROW
from strandline.plans.ordering import Ordered, facts, join_sized, order_rows, with_series_size
from strandline.plans.staging import stage

# One task transforms a series up to this many rows directly; longer ones are split.  Many keyed series share
# their tasks, a table without keys is one series.
DIRECT_ROWS = 1 << 20
WHOLE_TABLE_ROWS = 1 << 12
LINES_PER_TASK = 64
SHARED_NUMBERS = 1 << 16  # short series share a group of up to so many numbers


def hann(i: Column, n: Column) -> Column:
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2.0 * math.pi) * i / (n - F.lit(1.0)))


def finite_values(o: Ordered, y: str) -> Ordered:
    """Finite values only; numbered again only when some were dropped (a row count decides)."""
    d = o.df.select(*o.by, ROW, fx.finite(F.col(y).cast("double")).alias("y"))
    good = d.filter("y is not null")
    n = good.count()
    if n == o.n:
        return o.with_df(d)
    s = order_rows(good.withColumnRenamed(ROW, "_old"), "_old", o.by, n, o.layout)
    return s.with_df(s.df.drop("_old"))


def psd(o: Ordered, y: str, fs: float | None = None, direct_rows: int | None = None, ts: str | None = None) -> DataFrame:
    """Mean-removed, Hann-windowed one-sided power |X|^2 / n for k = 1 .. n/2 - 1: (by.., k, frequency, power).

    Without a rate `fs` it is inferred from the time column `ts` (see `sample_rate`), or 1.  Nothing under 4 values.  A series up to `direct_rows` is one small group.  A longer one is transformed in two rounds of short transforms over the rows and columns of an
    n1 x n2 arrangement, each task holding about sqrt(n) * 64 numbers; a length without a balanced
    divisor goes through an equivalent convolution of a length that has one.
    """
    if fs is None and ts is not None:
        rates = sample_rate(o, ts)
        if o.by:
            out = psd(o, y, 1.0, direct_rows)
            return join_sized(out, rates, list(o.by)).withColumn("frequency", F.col("frequency") * F.col("sample_rate")).drop("sample_rate")
        fs = rates.collect()[0]["sample_rate"]
    fs = 1.0 if fs is None else fs
    s = finite_values(o, y)
    if o.by:
        return _psd_keyed(s, fs, DIRECT_ROWS if direct_rows is None else direct_rows)
    direct_rows = WHOLE_TABLE_ROWS if direct_rows is None else direct_rows
    if s.n < 4:
        return _empty(o, "k bigint, frequency double, power double")
    if s.n <= direct_rows:
        return _psd_direct(s, fs)
    mean = facts(s.df.agg(F.avg("y").alias("m")))
    d = s.df.withColumn("_f", mean)
    re = (F.col("y") - F.col("_f.m")) * hann(F.col(ROW), F.lit(float(s.n)))
    line = d.select(F.col(ROW).alias("j"), re.alias("re"), F.lit(0.0).alias("im"))
    out = transform(line, s.n)
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.lit(float(s.n))
    return out.filter(f"j >= 1 and j < {s.n // 2}").select(
        F.col("j").alias("k"), (F.col("j") * F.lit(float(fs)) / F.lit(float(s.n))).alias("frequency"), power.alias("power")
    )


def _empty(o: Ordered, schema: str) -> DataFrame:
    return o.df.sparkSession.createDataFrame([], schema)


def _psd_keyed(s: Ordered, fs: float, direct_rows: int) -> DataFrame:
    """Short series side by side; all above `direct_rows`, however many, in one split transform keyed by series."""
    keys = list(s.by)
    sizes = s.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("_mean")).filter(F.col("n") > max(direct_rows, 3))
    long = sizes.withColumn("_p", _arrangements("n")).select(*keys, "n", "_mean", "_p.m", "_p.n1", "_p.n2", F.monotonically_increasing_id().alias("sid"))
    long = stage(long)
    kinds = long.agg(F.count_if(F.col("m") > 0).alias("chirps"), F.count_if(F.col("m") == 0).alias("splits")).collect()[0]
    if kinds.chirps + kinds.splits == 0:
        return _psd_direct(s, fs)
    d = join_sized(s.df, long, keys)
    re = (F.col("y") - F.col("_mean")) * hann(F.col(ROW), F.col("n").cast("double"))
    lines = d.filter("sid is not null").select("sid", "n", "m", "n1", "n2", F.col(ROW).alias("j"), re.alias("re"), F.lit(0.0).alias("im"))
    out = _transforms(lines, kinds.chirps > 0, kinds.splits > 0)
    out = join_sized(out, long.select("sid", "n", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), ["sid"], "inner")
    n, j = F.col("n"), F.col("j")
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / n
    out = out.filter((j >= 1) & (j < F.floor(n / 2))).select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], j.alias("k"), (j * F.lit(float(fs)) / n).alias("frequency"), power.alias("power")
    )
    rest = d.filter("sid is null").select(*s.df.columns)
    return _psd_direct(s.with_df(rest), fs).unionByName(out)


def _psd_direct(s: Ordered, fs: float) -> DataFrame:
    keys = list(s.by)
    schema = "".join(f"`{c}` {s.df.schema[c].dataType.simpleString()}, " for c in keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ROW)
        v = pdf["y"].to_numpy()
        n = len(v)
        k = np.arange(1, n // 2 if n >= 4 else 1)
        if len(k) == 0:
            return pdf.iloc[:0].assign(k=k, frequency=k * 1.0, power=k * 1.0)[[*keys, "k", "frequency", "power"]]
        win = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / (n - 1.0))
        f = np.fft.rfft((v - v.mean()) * win)[k]
        out = pd.DataFrame({"k": k, "frequency": k * fs / n, "power": (f.real**2 + f.imag**2) / n})
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "k", "frequency", "power"]]

    grouped = s.df.groupBy(*keys) if keys else s.df.groupBy(F.lit(0).alias("_one"))
    return grouped.applyInPandas(one, f"{schema}k bigint, frequency double, power double")


# ---------------------------------------------------------------- long transforms


def balanced_split(n: int) -> tuple[int, int]:
    """n = n1 * n2 with n1 <= n2 as close as possible."""
    for a in range(math.isqrt(n), 0, -1):
        if n % a == 0:
            return a, n // a
    return 1, n


def arrangement(n: int) -> tuple[int, int, int]:
    """(m, n1, n2): a balanced n1 x n2 arrangement of n itself (m = 0), or of the length m of an equivalent convolution."""
    n1, n2 = balanced_split(n)
    if n2 <= 64 * n1:
        return 0, n1, n2
    m = 1 << (2 * n - 1).bit_length()
    return (m, *balanced_split(m))


def _arrangements(n: str) -> Column:
    def plan(lengths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([arrangement(int(v)) for v in lengths], columns=["m", "n1", "n2"])

    return F.pandas_udf(plan, "m long, n1 long, n2 long")(n)


def transform(line: DataFrame, n: int) -> DataFrame:
    """Discrete Fourier transform of rows (j, re, im), j = 0 .. n-1, as rows (j, re, im)."""
    m, n1, n2 = arrangement(n)
    fixed = {"sid": 0, "n": n, "m": m, "n1": n1, "n2": n2}
    one = line.select(*[F.lit(v).cast("bigint").alias(c) for c, v in fixed.items()], "j", "re", "im")
    return _transforms(one, m > 0, m == 0).drop("sid")


def _transforms(lines: DataFrame, chirps: bool, splits: bool) -> DataFrame:
    """Transforms of any number of series side by side: rows (sid, n, m, n1, n2, j, re, im) to rows (sid, j, re, im)."""
    out = []
    if splits:
        out.append(_two_round(lines.filter("m = 0") if chirps else lines, False))
    if chirps:
        out.append(_chirp(lines.filter("m > 0") if splits else lines))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _groups() -> list[Column]:
    """Grouping keys of rows (sid, n1, n2, line): series of a size class share a group, long ones are cut by lines."""
    numbers = F.col("n1") * F.col("n2")
    size = F.ceil(F.log2(numbers)).cast("int")
    short = numbers <= SHARED_NUMBERS // 2
    some = F.when(short, F.floor(F.col("sid") * F.pow(F.lit(2.0), size) / SHARED_NUMBERS)).otherwise(F.col("sid"))
    return [F.when(short, size).alias("_l"), some.alias("_s"), F.when(~short, F.floor(F.col("line") / LINES_PER_TASK)).alias("_t")]


def _two_round(lines: DataFrame, inverse: bool) -> DataFrame:
    """Index j = a * n2 + b: transform over a for each b, twist, then over b for each output c.

    A group holds some lines of one long series, about LINES_PER_TASK * sqrt(n1 * n2) numbers, or up to
    SHARED_NUMBERS of short ones of similar length, whose lines of one length are transformed together.
    """
    sgn = 1.0 if inverse else -1.0
    fft = (lambda m: np.fft.ifft(m, axis=1) * m.shape[1]) if inverse else (lambda m: np.fft.fft(m, axis=1))
    schema = "sid bigint, n1 bigint, n2 bigint, line bigint, at bigint, re double, im double"

    def rows_of(pdf: pd.DataFrame, length: int, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sids, s = np.unique(pdf["sid"].to_numpy(), return_inverse=True)
        ids, where = np.unique(s * lines + pdf["line"].to_numpy(), return_inverse=True)
        m = np.zeros((len(ids), length), dtype=complex)
        m[where, pdf["at"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        return sids[ids // lines], ids % lines, m

    def frame(n1: int, n2: int, sid: np.ndarray, lines: np.ndarray, at: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        own = np.broadcast_to(sid[:, None], m.shape)
        return pd.DataFrame({"sid": own.ravel(), "n1": n1, "n2": n2, "line": lines.ravel(), "at": at.ravel(), "re": m.real.ravel(), "im": m.imag.ravel()})

    def first(pdf: pd.DataFrame, n1: int, n2: int) -> pd.DataFrame:
        n = n1 * n2
        sid, b, m = rows_of(pdf, n1, n2)
        c = np.arange(n1)
        m = fft(m) * np.exp(sgn * 2j * np.pi * ((b[:, None] * c[None, :]) % n) / n)
        lines, at = np.broadcast_arrays(c[None, :], b[:, None])
        return frame(n1, n2, sid, lines, at, m)

    def second(pdf: pd.DataFrame, n1: int, n2: int) -> pd.DataFrame:
        sid, c, m = rows_of(pdf, n2, n1)
        e = np.arange(n2)
        at, lines = c[:, None] + n1 * e[None, :], np.zeros((len(c), n2), dtype="int64")
        return frame(n1, n2, sid, lines, at, fft(m))

    def by_shape(one):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.concat([one(part, int(n1), int(n2)) for (n1, n2), part in pdf.groupby(["n1", "n2"], sort=False)])

        return run

    task = _groups()
    d = lines.select("sid", "n1", "n2", (F.col("j") % F.col("n2")).alias("line"), F.floor(F.col("j") / F.col("n2")).alias("at"), "re", "im")
    d = d.groupBy(*task).applyInPandas(by_shape(first), schema)
    d = d.groupBy(*task).applyInPandas(by_shape(second), schema)
    return d.select("sid", F.col("at").alias("j"), "re", "im")


SEQUENCE = 1 << 16


def _chirp(lines: DataFrame) -> DataFrame:
    """Any length as a circular convolution of power-of-two length m with a quadratic-phase sequence.

    The sequence of a length is made and transformed once for all series of that length.
    """
    n, m, j = F.col("n"), F.col("m"), F.col("j")

    def phase(k: Column, sign: float) -> tuple[Column, Column]:
        # k * k in two parts, reduced in between: the plain square overflows above 3 * 10^9 rows
        high = F.shiftright(k, 16) * k % (n * 2) * 65536
        angle = F.lit(sign * math.pi) / n * ((high + k % 65536 * k) % (n * 2)).cast("double")
        return F.cos(angle), F.sin(angle)

    c, s = phase(j, -1.0)
    shape = ["n", "m", "n1", "n2"]
    turned = lines.select("sid", *shape, "j", (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))
    lengths = stage(lines.select("sid", *shape).distinct())
    d = lengths.select(*shape).distinct().withColumn("_hi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(m / SEQUENCE) - 1)))
    d = d.withColumn("j", F.explode(F.sequence(F.col("_hi") * SEQUENCE, F.least(m, (F.col("_hi") + 1) * SEQUENCE) - 1)))
    wrapped = F.when(j < n, j).when(j > m - n, m - j)
    cb, sb = phase(wrapped, 1.0)
    b = d.select(n.alias("sid"), "n1", "n2", "j", cb.alias("re"), sb.alias("im")).filter("re is not null")
    fa = join_sized(_two_round(turned, False), lengths, ["sid"], "inner")
    fb = _two_round(b, False).select(F.col("sid").alias("n"), "j", F.col("re").alias("rb"), F.col("im").alias("ib"))
    prod = fa.join(fb, ["n", "j"]).select(
        "sid", "n1", "n2", "j", (F.col("re") * F.col("rb") - F.col("im") * F.col("ib")).alias("re"),
        (F.col("re") * F.col("ib") + F.col("im") * F.col("rb")).alias("im"),
    )
    conv = join_sized(_two_round(prod, True), lengths, ["sid"], "inner").filter(j < n)
    re, im = F.col("re") / m.cast("double"), F.col("im") / m.cast("double")
    return conv.select("sid", "j", (re * c - im * s).alias("re"), (re * s + im * c).alias("im"))


def top_peaks(spectrum: DataFrame, k: int = 6) -> DataFrame:
    """Strongest bins, frequency to 3 places."""
    top = spectrum.orderBy(F.desc("power"), "k").limit(k)
    return top.select("k", F.round("frequency", 3).alias("frequency_hz"), "power")


# ---------------------------------------------------------------- spectrogram


def clamp_window(window: int) -> int:
    return min(max(window, 16), 4096)


def stft(o: Ordered, y: str, window: int = 256) -> DataFrame:
    """Hann-windowed magnitudes of half-overlapping frames: (by.., frame, bin, magnitude).

    The last, zero-padded frame is always added; a series shorter than a window gives nothing.
    Each row goes to at most two frames, so a task holds single windows only.
    """
    w = clamp_window(window)
    hop = w // 2
    s = with_series_size(finite_values(o, y))
    keys = list(s.by)
    schema = "".join(f"`{c}` {s.df.schema[c].dataType.simpleString()}, " for c in keys)
    full = F.floor((F.col("_n") - w) / hop) + 1
    d = s.df.filter(F.col("_n") >= w).withColumn("_full", full)
    last = F.when(F.col("_full") * hop < F.col("_n"), F.col("_full")).otherwise(F.col("_full") - 1)
    # a row starts in frame row div hop; an odd window's rows past 2 * hop still belong to frame - 2
    mine = F.floor(F.col(ROW) / hop)
    frames = F.array(*[F.when(mine - b >= 0, mine - b) for b in range(2 + w % 2)])
    d = d.withColumn("frame", F.explode(F.array_compact(frames)))
    d = d.withColumn("_i", F.col(ROW) - F.col("frame") * hop)
    d = d.filter((F.col("_i") < w) & (F.col("frame") <= last))
    batch = max(1, 4096 // w)

    def mags(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, where = np.unique(pdf["frame"].to_numpy(), return_inverse=True)
        m = np.zeros((len(ids), w))
        m[where, pdf["_i"].to_numpy()] = pdf["y"].to_numpy()
        win = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(w) / (w - 1.0))
        mag = np.abs(np.fft.rfft(m * win, axis=1))[:, :hop]
        out = pd.DataFrame(
            {"frame": np.repeat(ids, hop), "bin": np.tile(np.arange(hop, dtype="int32"), len(ids)), "magnitude": mag.ravel()}
        )
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "frame", "bin", "magnitude"]]

    d = d.select(*keys, "frame", "_i", "y", F.floor(F.col("frame") / batch).alias("_t"))
    return d.groupBy(*keys, "_t").applyInPandas(mags, f"{schema}frame bigint, bin int, magnitude double")


def stft_axes(frames: DataFrame, window: int, fs: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Frame count, bins, Nyquist frequency and covered time of a spectrogram."""
    w = clamp_window(window)
    d = frames.groupBy(*by).agg((F.max("frame") + 1).alias("n_frames"))
    return d.select(
        *by, "n_frames", F.lit(w // 2).alias("bins"), F.lit(fs / 2.0).alias("nyquist"),
        (F.col("n_frames") * F.lit(w / 2.0) / F.lit(float(fs))).alias("duration"),
    )
