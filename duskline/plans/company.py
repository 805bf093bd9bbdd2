"""The whole study on a raw company-month panel: raw CSV rows to train and test sets.

Each step takes and returns DataFrames over all years at once. The year is a column, the
event is status 5, and columns are found by name in every year.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from duskline.functions.dates import parse_period
from duskline.functions.numbers import filled_cells, quoted
from duskline.operators import (
    datasets as ds,
    exchange as xc,
    exclusion as ex,
    features as ft,
    profiles as pr,
    projection as pj,
    sampling as sp,
    timeline as tl,
)
from duskline.sources.scratch import settle

# Names and codes of the raw files.
STATUS = "KODAS_STATUSAI"
EVENT_STATUS = 5
SECTOR = "VKR_SEKCIJA"
UNCLEAR_SECTOR = "X"
EXISTED = "AR_EGZISTAVO"
FORM = "KODAS_FORMA"
CATEGORY = "APS"
SEGMENT, SEGMENTS = "SEGMENTAS", ["MMM", "DMM", "VMM"]
FILING, FILINGS = "laik_tipas_pvm", ["M", "P"]
NUMBERS_AS_TEXT = ["pardavimai_pvm_dekl", "pvm_dekl_36", "pirkimai_pvm_dekl"]
PRESENCE_SPAN = ("darb_su_alga", "NEAPMOK_PROC")
MONTHLY_SPAN_EVENTS = ("pardavimai_pvm_dekl", "VADOV_POK")
MONTHLY_SPAN_HEALTHY = ("pardavimai_pvm_dekl", "likutis")
ANNUAL_SPAN = ("B_PARDAVIMO_PAJAMOS", "R_BENDR_MOK_KOEF")
AGE = "IMONES_AMZIUS_MM"
SCORE = "Z_score"
# Columns without use or with repeated information.
REDUNDANT = [
    "n_PVM_MEN", "FA_vald_dalis", "KLN_KLNT_TYPE", "FIN_ATASKAITA", "bal_men", "PVM_MOK",
    "B_FIN_ATSK_KAT", "NAUJAS_PVM_MOK", "KODAS_FORMA", "APRASYMAS_FORMA", "EV1_ID_NAME_TR",
    "yra_nepriemoka", "GRUPE",
]
# Columns in national currency before the changeover.
MONEY = [
    "B_PARDAVIMO_PAJAMOS", "B_PELNAS_PRIES_APMOKEST", "B_GRYNASIS_PELNAS",
    "B_PARDAVIMU_SAVIKAINA", "B_SANAUDOS", "B_TURTO_IS_VISO", "B_PINIGAI_IR_EKVIVALENTAI",
    "B_TRUMP_TURTAS", "B_ATSARGOS", "B_NUOSAVAS_KAPITALAS", "B_TRUMP_ISIPAREIG",
    "R_APYVART_KAPITALAS", "R_ISIPAREIGOJIMAI", "likutis", "DU_KASTAI", "DU_NUO_PARDAVIMU",
    "PAJ_DARB",
]
# The five ratios of the bankruptcy score on these columns.
SCORE_TERMS = [
    (1.2, "R_APYVART_KAPITALAS", "B_TURTO_IS_VISO"),
    (1.4, "B_GRYNASIS_PELNAS", "B_TURTO_IS_VISO"),
    (3.3, "B_PELNAS_PRIES_APMOKEST", "B_TURTO_IS_VISO"),
    (0.6, "B_NUOSAVAS_KAPITALAS", "R_ISIPAREIGOJIMAI"),
    (0.99, "B_PARDAVIMO_PAJAMOS", "B_TURTO_IS_VISO"),
]
# Only event rows have these; healthy rows are built without them.
EVENT_ONLY = ["VADOV_POK", "laik_tipas_pvm_M", "laik_tipas_pvm_P"]
NOT_WIDENED = ["kiek_adresu"]
# Healthy companies per event company in the ratio study.
RATIOS = [1, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 25, 30]


def is_event():
    return F.col(STATUS) == EVENT_STATUS


def with_period(raw: DataFrame) -> DataFrame:
    """One row per company and month, the month as a date, and a missing status as 0.

    Of several rows of a month the event row is kept, then the first by its cells in order;
    rows whose date is no date have no month and go: ``undated_rows`` counts them.
    """
    df = raw.withColumn("period", parse_period("DATE")).filter(F.col("period").isNotNull())
    df = pj.fill_column(df.withColumn("year", F.year("period")), STATUS, 0)
    # The least of a month's rows, event rows before others: one grouping, whose tasks send one row
    # per company and month.
    cells = F.struct((~is_event()).alias("_later"), *[F.col(quoted(c)) for c in df.columns if c not in ("id", "period")])
    return df.groupBy("id", "period").agg(F.min(cells).alias("_row")).select(
        *[F.col(c if c in ("id", "period") else f"_row.{quoted(c)}") for c in df.columns]
    )


def undated_rows(raw: DataFrame) -> DataFrame:
    """Rows per status text whose date cannot be read."""
    return raw.filter(parse_period("DATE").isNull()).groupBy(STATUS).agg(F.count("*").alias("rows"))


def clean_rows(dated: DataFrame) -> DataFrame:
    """Whole-company exclusions: unclear sector, too young, no yearly data. ``dated`` is as from ``with_period``."""
    df = dated
    return ex.clean_rows(
        df, is_event(), F.col(SECTOR) == UNCLEAR_SECTOR, EXISTED, pj.span(df, *PRESENCE_SPAN)
    )


def category_ranks(dated: DataFrame, c: str) -> DataFrame:
    """Risk rank per category value over all years, from the company, category and status alone."""
    df = dated.select("id", F.col(c).cast("string").alias(c), STATUS)
    return pr.risk_rank(pr.category_risk(df, c, is_event()))


def clean_columns(
    cleaned: DataFrame, ranks: dict[str, DataFrame], sparse_limit: float = 0.98
) -> DataFrame:
    """Parse, drop, convert, cut at the event, fill, encode and score."""
    df = pj.parse_numbers(cleaned, [c for c in NUMBERS_AS_TEXT if c in cleaned.columns])
    df = pj.drop_columns(df, REDUNDANT)
    df = pj.convert_currency(df, [c for c in MONEY if c in df.columns])
    df = settle(tl.truncate_after_event(df, is_event()), "truncated")
    df = pj.drop_sparse(df, sparse_limit, keep=["id", "period", "year", STATUS])
    if {"B_PELNAS_PRIES_APMOKEST", "B_GRYNASIS_PELNAS"} <= set(df.columns):
        df = pj.impute_from(
            df, "B_PELNAS_PRIES_APMOKEST", "B_GRYNASIS_PELNAS", F.col("B_GRYNASIS_PELNAS") <= 0
        )
    df = pj.fill_all(df)
    for c, values in ((SEGMENT, SEGMENTS), (FILING, FILINGS)):
        df = pj.indicators(df, c, values)
    for c, table in ranks.items():
        df = pj.map_category(df.withColumn(c, F.col(c).cast("string")), c, table)
        found = pj.distinct_values(table.select(F.col("rank").cast("int").alias("rank")), "rank")
        df = pj.rank_dummies(df, c, found)
    df = pj.drop_columns(df, [SEGMENT, FILING, *ranks])
    return df.withColumn(SCORE, pj.ratio_score(SCORE_TERMS))


@dataclass(frozen=True)
class Blocks:
    """Monthly and annual columns that enter the wide row."""

    monthly: list[str]
    annual: list[str]

    @classmethod
    def of(cls, panel: DataFrame, healthy: bool = False) -> Blocks:
        off = NOT_WIDENED + (EVENT_ONLY if healthy else [])
        df = panel.drop(*off)
        monthly = pj.span(df, *(MONTHLY_SPAN_HEALTHY if healthy else MONTHLY_SPAN_EVENTS))
        encoded = pj.span(df, f"{SEGMENT}_{SEGMENTS[0]}", SCORE)
        annual = ([AGE] if AGE in df.columns else []) + pj.span(df, *ANNUAL_SPAN) + encoded
        return cls([c for c in monthly if c not in NOT_WIDENED], annual)

    def features(self) -> list[str]:
        return ft.lag_names(self.monthly) + ft.annual_names(self.annual)


def statements(panel: DataFrame, blocks: Blocks) -> DataFrame:
    """Annual block per company and year: the December row."""
    return pj.annual_rows(panel).select("id", "year", *blocks.annual)


def events(panel: DataFrame, first_year: int) -> DataFrame:
    """Event month per company; the first year counts only from July."""
    return tl.event_floor(tl.event_dates(panel, is_event()), first_year)


def widen(panel: DataFrame, anchors: DataFrame, blocks: Blocks, min_filled: int) -> DataFrame:
    """Wide rows of anchors, without those that have fewer than ``min_filled`` cells set."""
    cells = blocks.features()
    wide = ft.feature_rows(
        settle(anchors, "anchors"), panel, blocks.monthly, statements(panel, blocks), blocks.annual
    )
    return pj.drop_empty_rows(wide, cells, len(cells) - min_filled)


def event_rows(panel: DataFrame, first_year: int, min_filled: int = 11) -> DataFrame:
    rows = widen(panel, events(panel, first_year), Blocks.of(panel), min_filled)
    return rows.withColumn("status", F.lit(1))


def healthy_rows(panel: DataFrame, anchors: DataFrame, min_filled: int = 1) -> DataFrame:
    rows = widen(panel, anchors, Blocks.of(panel, healthy=True), min_filled)
    return rows.withColumn("status", F.lit(0))


def shared(rows: DataFrame) -> DataFrame:
    """Event rows without the columns healthy rows lack."""
    gone = ft.lag_names(["VADOV_POK"]) + ft.annual_names(EVENT_ONLY[1:])
    return pj.drop_columns(rows, gone)


def monthly_sets(panel: DataFrame, rows: DataFrame, years: list[int], test_year: int) -> DataFrame:
    """All companies at each calendar month of each year against that month's events.

    Nearly every company-month is an anchor here, so the dense lags serve them all from
    one sort by company. Which months a company is asked for is settled before that sort, and
    the wide rows stay where it left them.
    """
    blocks = Blocks.of(panel, healthy=True)
    lags = ft.lag_features_dense(panel, blocks.monthly, years=years, without=ds.event_months(rows))
    wide = ft.annual_features_dense(lags, statements(panel, blocks), blocks.annual)
    cells = blocks.features()
    healthy = pj.drop_empty_rows(wide, cells, len(cells) - 1).withColumn("status", F.lit(0))
    return ds.month_table(healthy, shared(rows), test_year)


def ratio_sets(
    panel: DataFrame,
    rows: DataFrame,
    ratios: list[int] = RATIOS,
    test_year: int = 2018,
    seed: int = 101,
    scope: str = "ever",
) -> DataFrame:
    """Controls matched to the event calendar at each ratio, with all events.

    A month falls short only where no assignment of companies to months could fill it.
    ``scope="ever"`` keeps later event companies out of the controls and uses a company
    once per ratio; ``"year"`` draws every year on its own from companies without an
    event in that year.
    """
    many = F.explode(F.array(*[F.lit(r) for r in ratios]))
    e = rows.select("id", "event")
    by = ["ratio"]
    quota_events = e.withColumn("ratio", many)
    if scope == "ever":
        pool = ex.healthy_pool(ex.distinct_ids(panel), e)
    else:
        by = ["ratio", "year"]
        quota_events = quota_events.withColumn("year", F.year("event"))
        seen = panel.select("id", "year").distinct()
        pool = ex.minus_ids(seen, e.select("id", F.year("event").alias("year")), ["id", "year"])
    blocks = Blocks.of(panel, healthy=True)

    def filled(anchors: DataFrame) -> DataFrame:
        lags = settle(ft.filled_lag_cells(anchors, panel, blocks.monthly), "lag_cells")
        known = ft.annual_features(lags, statements(panel, blocks), blocks.annual)
        set_cells = F.col("filled") + filled_cells(ft.annual_names(blocks.annual))
        return known.select(*anchors.columns, set_cells.alias("filled"))

    controls = xc.match_exchanged(
        settle(pool.withColumn("ratio", many), "pool"),
        settle(sp.control_quotas(quota_events, F.col("ratio"), by), "quotas"),
        seed,
        filled,
        by=by,
    ).drop("year")
    return ds.ratio_sets(healthy_rows(panel, controls), shared(rows), ratios, test_year)


def raw_schema(header: list[str], text: list[str]) -> T.StructType:
    """Schema of a raw file from its header: named text columns, a long key, doubles."""
    kinds = {c: T.StringType() for c in ["DATE", *NUMBERS_AS_TEXT, *text]}
    first = [T.StructField(header[0], T.LongType())]
    return T.StructType(
        first + [T.StructField(c, kinds.get(c, T.DoubleType())) for c in header[1:]]
    )
