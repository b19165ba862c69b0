"""Code lists.  Small, fixed dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Energy product codes of the monthly production table.
PRODUCT_CODES = (
    "TOTAL", "X9900", "RA000", "N9000", "CF", "CF_R", "RA100", "RA200", "RA300",
    "RA400", "RA500_5160", "C0000", "CF_NR", "G3000", "O4000XBIO",
)
# The products that add up to the total without overlap.
PRODUCT_PARTS = (
    "X9900", "N9000", "CF_R", "RA100", "RA200", "RA300", "RA400", "RA500_5160",
    "C0000", "CF_NR", "G3000", "O4000XBIO",
)
# The macro products.
MACRO_PRODUCTS = ("RA000", "CF", "N9000", "X9900")
# Consumption sector codes.
SECTOR_CODES = (
    "FC", "FC_IND_E", "FC_TRA_E", "FC_OTH_CP_E", "FC_OTH_HH_E", "FC_OTH_AF_E",
)
# States shown when no category is chosen.
DEFAULT_STATES = ("Germany", "France", "Italy", "Spain")

# Product labels.
PRODUCT_LABELS = {
    "TOTAL": "Totale",
    "X9900": "Altri combustibili",
    "RA000": "Rinnovabili",
    "N9000": "Nucleare",
    "CF": "Carburante Fossile",
    "CF_R": "Fossile Rinnovabile",
    "RA100": "Idroelettrico",
    "RA200": "Geotermico",
    "RA300": "Eolico",
    "RA400": "Solare",
    "RA500_5160": "Altre Rinnovabili",
    "C0000": "Carbone",
    "CF_NR": "Fossile non Rinnovabile",
    "G3000": "Gas Naturale",
    "O4000XBIO": "Petrolio e Derivati",
}
# Short sector labels used in shares and comparisons.
SECTOR_LABELS = {
    "FC_IND_E": "Industria",
    "FC_TRA_E": "Trasporti",
    "FC_OTH_CP_E": "Servizi",
    "FC_OTH_HH_E": "Familiare",
    "FC_OTH_AF_E": "Agricolo",
}
# Long sector labels of the code table; leading blanks belong to them.
SECTOR_TITLES = {
    "FC": "Consumo Totale",
    "FC_IND_E": " Settore Industriale",
    "FC_TRA_E": " Settore dei Trasporti",
    "FC_OTH_CP_E": "Commercio e Servizi pubblici",
    "FC_OTH_HH_E": "Consumo Familiare",
    "FC_OTH_AF_E": " Settore Agricolo e Forestale",
}

# Fixed values (ISO 3166): alpha-2, short name, numeric code, member of the 27.
_COUNTRIES = (
    ("AL", "Albania", 8, False),
    ("AT", "Austria", 40, True),
    ("BA", "Bosnia and Herzegovina", 70, False),
    ("BE", "Belgium", 56, True),
    ("BG", "Bulgaria", 100, True),
    ("CH", "Switzerland", 756, False),
    ("CY", "Cyprus", 196, True),
    ("CZ", "Czech Republic", 203, True),
    ("DE", "Germany", 276, True),
    ("DK", "Denmark", 208, True),
    ("EE", "Estonia", 233, True),
    ("ES", "Spain", 724, True),
    ("FI", "Finland", 246, True),
    ("FR", "France", 250, True),
    ("GE", "Georgia", 268, False),
    ("GR", "Greece", 300, True),
    ("HR", "Croatia", 191, True),
    ("HU", "Hungary", 348, True),
    ("IE", "Ireland", 372, True),
    ("IS", "Iceland", 352, False),
    ("IT", "Italy", 380, True),
    ("LI", "Liechtenstein", 438, False),
    ("LT", "Lithuania", 440, True),
    ("LU", "Luxembourg", 442, True),
    ("LV", "Latvia", 428, True),
    ("MD", "Moldova", 498, False),
    ("ME", "Montenegro", 499, False),
    ("MK", "North Macedonia", 807, False),
    ("MT", "Malta", 470, True),
    ("NL", "Netherlands", 528, True),
    ("NO", "Norway", 578, False),
    ("PL", "Poland", 616, True),
    ("PT", "Portugal", 620, True),
    ("RO", "Romania", 642, True),
    ("RS", "Serbia", 688, False),
    ("SE", "Sweden", 752, True),
    ("SI", "Slovenia", 705, True),
    ("SK", "Slovakia", 703, True),
    ("TR", "Turkey", 792, False),
    ("UA", "Ukraine", 804, False),
    ("UK", "United Kingdom", 826, False),
)


def fixed_rows(spark: SparkSession, rows, names: str) -> DataFrame:
    """A small table of plain values, as a relation whose size Spark knows.

    A local list has no known size for the planner, so a join with it would shuffle the
    other side, however large that is.
    """

    def literal(value):
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(value).upper() if isinstance(value, bool) else str(value)

    lines = ", ".join(f"({', '.join(map(literal, row))})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {lines} AS t({names})")


def countries(spark: SparkSession) -> DataFrame:
    """``state, name, iso_numeric, member`` for the states of the source tables."""
    return fixed_rows(spark, _COUNTRIES, "state, name, iso_numeric, member")


def labels(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    """A ``code, label`` dimension from a plain mapping."""
    return fixed_rows(spark, mapping.items(), "code, label")
