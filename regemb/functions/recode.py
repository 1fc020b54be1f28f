"""Column recodes (O1-O15), the recode profile (O24) and count regrouping.

Every recode is a built-in Column expression (map literals, ``CASE``
chains, ``coalesce``), so it runs inside whole-stage codegen.  Census codes
arrive as text; they are compared by numeric meaning via ``try_cast`` and
recoded levels are written back as text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES: these must equal the published census recodes for results to
# match.  Stated plainly, in natural order.

# O1: first two characters of a NAICS code -> sector
NAICS_SECTORS = {
    "11": "Agriculture", "21": "Extraction", "22": "Utilities", "23": "Construction",
    "31": "Manufacturing", "32": "Manufacturing", "33": "Manufacturing", "3M": "Manufacturing",
    "42": "Wholesale", "44": "Retail", "45": "Retail", "4M": "Retail",
    "48": "Transportation", "49": "Transportation", "51": "Information",
    "52": "Financial Services", "53": "Rental and Leasing", "54": "Science and Technical",
    "55": "Management", "56": "Misc Professions", "61": "Education", "62": "Medical",
    "71": "Entertainment", "72": "Tourism", "81": "Services", "92": "Administration",
    "99": "Unemployed",
}

# Occupation groups: lowest code of each group
OCCUPATION_GROUPS = [
    (0, "N/A"),
    (1, "Management, Business, Science, and Arts Occupations"),
    (500, "Business Operations Specialists"),
    (800, "Financial Specialists"),
    (1000, "Computer and Mathematical Occupations"),
    (1300, "Architecture and Engineering Occupations"),
    (1600, "Life, Physical, and Social Science Occupations"),
    (2000, "Community and Social Services Occupations"),
    (2100, "Legal Occupations"),
    (2200, "Education, Training, and Library Occupations"),
    (2600, "Arts, Design, Entertainment, Sports, and Media Occupations"),
    (3000, "Healthcare Practitioners and Technical Occupations"),
    (3600, "Healthcare Support Occupations"),
    (3700, "Protective Service Occupations"),
    (4000, "Food Preparation and Serving Occupations"),
    (4200, "Building and Grounds Cleaning and Maintenance Occupations"),
    (4300, "Personal Care and Service Occupations"),
    (4700, "Sales and Related Occupations"),
    (5000, "Office and Administrative Support Occupations"),
    (6000, "Farming, Fishing, and Forestry Occupations"),
    (6200, "Construction and Extraction Occupations"),
    (6800, "Extraction Workers"),
    (7000, "Installation, Maintenance, and Repair Workers"),
    (7700, "Production Occupations"),
    (9000, "Transportation and Material Moving Occupations"),
    (9800, "Military Specific Occupations"),
]

# RAC1P code -> ethnicity label (non-Hispanic rows)
ETHNICITY = {1: "white", 2: "black", 3: "amerindian", 4: "amerindian", 5: "amerindian",
             6: "asian", 7: "amerindian", 8: "other/biracial", 9: "other/biracial"}

# School grade, new codes -> old codes
SCHG_NEW_TO_OLD = {1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 3, 7: 4, 8: 4, 9: 4, 10: 4,
                   11: 5, 12: 5, 13: 5, 14: 5, 15: 6, 16: 7}

# Educational attainment, new codes -> old codes
SCHL_NEW_TO_OLD = {1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2, 7: 2, 8: 3, 9: 3, 10: 4, 11: 4,
                   12: 5, 13: 6, 14: 7, 15: 8, 16: 9, 17: 9, 18: 10, 19: 11, 20: 12,
                   21: 13, 22: 14, 23: 15, 24: 16}

# Military service, old codes -> new codes
MIL_OLD_TO_NEW = {1: 1, 2: 2, 3: 2, 4: 3, 5: 4}

# Fertility; code 8 (suppressed) becomes missing
FER_NEW_TO_OLD = {1: 1, 2: 2, 8: None}

# Language; sparse changes, every other code in 0..999 maps to itself
LANP_NEW_TO_OLD = {602: 989, 675: 986, 689: 986, 694: 986, 750: 988, 761: 988, 819: 993}
LANP_OLD_TO_COMMON = {966: 993}

# Ancestry; sparse changes, identity elsewhere on 0..999
ANCP_NEW_TO_OLD = {94: 87, 131: 176, 146: 144, 168: 434, 169: 434, 181: 32, 185: 51,
                   194: 32, 219: 215, 411: 499, 427: 499, 515: 587, 588: 587, 607: 799,
                   714: 799, 825: 899, 940: 939}
ANCP_OLD_TO_COMMON = {794: 995, 936: 935}

# Detailed race (RAC2P) labels common to old and new code lists
RAC2P_OLD = {
    1: 'White',
    2: 'Black or African American',
    3: 'Apache',
    4: 'Blackfeet',
    5: 'Cherokee',
    6: 'Cheyenne',
    7: 'Chickasaw',
    8: 'Chippewa',
    9: 'Choctaw',
    10: 'Other specified American Indian tribes',
    11: 'Comanche',
    12: 'Creek',
    13: 'Crow',
    14: 'Other specified American Indian tribes',
    15: 'Other specified American Indian tribes',
    16: 'Iroquois',
    17: 'Lumbee',
    18: 'Other specified American Indian tribes',
    19: 'Navajo',
    20: 'Other specified American Indian tribes',
    21: 'Pima',
    22: 'Potawatomi',
    23: 'Pueblo',
    24: 'Puget Sound Salish',
    25: 'Seminole',
    26: 'Sioux',
    27: "Tohono O'Odham",
    28: 'Other specified American Indian tribes',
    29: 'Yaqui',
    30: 'Other specified American Indian tribes',
    31: 'Other specified American Indian tribes',
    32: 'All other specified American Indian tribe combinations',
    33: 'American Indian and Alaska Native, not specified',
    34: 'Alaskan Athabascan',
    35: 'Aleut',
    36: 'Inupiat',
    37: 'Tlingit-Haida',
    38: 'Other Alaska Native',
    39: 'American Indian and Alaska Native, not specified',
    40: 'Asian Indian',
    41: 'Bangladeshi',
    42: 'Cambodian',
    43: 'Chinese',
    44: 'Filipino',
    45: 'Hmong',
    46: 'Indonesian',
    47: 'Japanese',
    48: 'Korean',
    49: 'Laotian',
    50: 'Malaysian',
    51: 'Pakistani',
    52: 'Sri Lankan',
    53: 'Thai',
    54: 'Vietnamese',
    55: 'Other Asian',
    56: 'Other Asian',
    57: 'All combinations of Asian races only',
    58: 'Native Hawaiian',
    59: 'Samoan',
    60: 'Tongan',
    61: 'Other Native Hawaiian and Other Pacific Islander',
    62: 'Guamanian or Chamorro',
    63: 'Other Native Hawaiian and Other Pacific Islander',
    64: 'Other Native Hawaiian and Other Pacific Islander',
    65: 'Other Native Hawaiian and Other Pacific Islander',
    66: 'Some Other Race',
    67: 'Two or More Races',
}
RAC2P_NEW = {
    1: 'White',
    2: 'Black or African American',
    3: 'Apache',
    4: 'Blackfeet',
    5: 'Cherokee',
    6: 'Cheyenne',
    7: 'Chickasaw',
    8: 'Chippewa',
    9: 'Choctaw',
    10: 'Comanche',
    11: 'Creek',
    12: 'Crow',
    13: 'Other specified American Indian tribes',
    14: 'Iroquois',
    15: 'Lumbee',
    16: 'Other specified American Indian tribes',
    17: 'Navajo',
    18: 'Pima',
    19: 'Potawatomi',
    20: 'Pueblo',
    21: 'Puget Sound Salish',
    22: 'Seminole',
    23: 'Sioux',
    24: 'Other specified American Indian tribes',
    25: "Tohono O'Odham",
    26: 'Yaqui',
    27: 'Other specified American Indian tribes',
    28: 'All other specified American Indian tribe combinations',
    29: 'American Indian and Alaska Native, not specified',
    30: 'Alaskan Athabascan',
    31: 'Tlingit-Haida',
    32: 'Inupiat',
    33: 'Other Alaska Native',
    34: 'Aleut',
    35: 'Other Alaska Native',
    36: 'All other specified American Indian tribe combinations',
    37: 'American Indian and Alaska Native, not specified',
    38: 'Asian Indian',
    39: 'Bangladeshi',
    40: 'Other Asian',
    41: 'Other Asian',
    42: 'Cambodian',
    43: 'Chinese',
    44: 'Chinese',
    45: 'Filipino',
    46: 'Hmong',
    47: 'Indonesian',
    48: 'Japanese',
    49: 'Korean',
    50: 'Laotian',
    51: 'Malaysian',
    52: 'Other Asian',
    53: 'Other Asian',
    54: 'Pakistani',
    55: 'Sri Lankan',
    56: 'Thai',
    57: 'Vietnamese',
    58: 'Other Asian',
    59: 'All combinations of Asian races only',
    60: 'Native Hawaiian',
    61: 'Samoan',
    62: 'Tongan',
    63: 'Guamanian or Chamorro',
    64: 'Other Native Hawaiian and Other Pacific Islander',
    65: 'Other Native Hawaiian and Other Pacific Islander',
    66: 'Other Native Hawaiian and Other Pacific Islander',
    67: 'Some Other Race',
    68: 'Two or More Races',
}

# Attainment code at or above which a person "has a degree"
DEGREE_CUTOFF_NEW = 20
DEGREE_CUTOFF_COMMON = 12
# ---------------------------------------------------------------------------


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code(c: str | Column) -> Column:
    """Numeric meaning of a text code (null when not a number)."""
    return _c(c).cast("string").try_cast("int")


def map_literal(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items()
                          for x in (F.lit(k), F.lit(v).cast("string") if v is not None
                                    else F.lit(None).cast("string"))])


class UnknownCodeError(ValueError):
    pass


def industry_sector(c: str | Column, on_unknown: str = "error") -> Column:
    """O1: NAICS code -> sector by its first two characters; null stays null.

    ``on_unknown``: ``"error"`` raises in the task (as the reference does);
    ``"null"`` leaves unknown prefixes missing.
    """
    x = _c(c).cast("string")
    got = map_literal(NAICS_SECTORS)[F.substring(x, 1, 2)]
    if on_unknown == "null":
        return got
    return F.when(x.isNull(), F.lit(None).cast("string")).when(got.isNotNull(), got) \
            .otherwise(F.raise_error(F.concat(F.lit("unknown NAICS prefix: "), x)))


def first_present(new: str | Column, old: str | Column) -> Column:
    """O2/O3: the newer code when present, else the older."""
    return F.coalesce(_c(new), _c(old))


def degree_category_join(df: DataFrame, col: str, lookup: DataFrame, out: str | None = None,
                         code_col: str = "code", cat_col: str = "cat_code") -> DataFrame:
    """Field-of-degree code -> category code, by a join with the code table
    that ``sources.lookups`` reads; unknown codes have no category."""
    from regemb.operators.lookup import code as normal, lookup_join
    lk = lookup.select(F.col(code_col), F.col(cat_col).cast("string").alias("__cat"))
    return lookup_join(df, lk, [(normal(col), normal(code_col))], {"__cat": out or col},
                       what="the code table")


def ethnicity(hisp: str | Column, rac1p: str | Column) -> Column:
    """``hispanic`` unless HISP is 1 (null counts as not 1), else by RAC1P."""
    return F.when(~code(hisp).eqNullSafe(F.lit(1)), F.lit("hispanic")) \
            .otherwise(map_literal(ETHNICITY)[code(rac1p)])


def any_hispanic(hisp: str | Column) -> Column:
    """1 when HISP > 1, else 0 (null -> 0)."""
    return F.coalesce(code(hisp) > 1, F.lit(False)).cast("int")


def occupation_group(c: str | Column) -> Column:
    """The group whose lowest code is the largest one not above the code."""
    x = _c(c).cast("string").try_cast("double")
    expr = F.when(x.isNull(), F.lit(None).cast("string"))
    for lo, name in reversed(OCCUPATION_GROUPS):
        expr = expr.when(x >= lo, F.lit(name))
    return expr


def has_degree(schl: str | Column, cutoff: int = DEGREE_CUTOFF_NEW) -> Column:
    """1 when the attainment code is at least ``cutoff``."""
    return F.coalesce(code(schl) >= cutoff, F.lit(False)).cast("int")


def remap(c: str | Column, mapping: dict, identity_default: bool = False) -> Column:
    """Map a numeric code; unmapped -> null, or itself when
    ``identity_default`` (the language/ancestry maps cover 0..999 that way)."""
    got = map_literal(mapping)[code(c)]
    if identity_default:
        x = code(c)
        in_range = (x >= 0) & (x <= 999)
        keyed = F.array_contains(F.map_keys(map_literal(mapping)), x)
        return F.when(keyed, got).when(in_range, x.cast("string"))
    return got


# ---------------------------------------------------------------------------
# A recode profile


@dataclass
class RecodeProfile:
    """Which columns a recode keeps, derives, skips or expects absent.

    ``derive`` maps an output column to its expression; ``keep`` lists
    columns passed through; ``skip`` columns are dropped; ``absent`` names
    columns that must not exist.  The profile must cover the input exactly.
    """

    derive: dict[str, Column] = field(default_factory=dict)
    keep: set[str] = field(default_factory=set)
    skip: set[str] = field(default_factory=set)
    absent: set[str] = field(default_factory=set)
    meta: set[str] = field(default_factory=set)


class ProfileCoverageError(ValueError):
    pass


def apply_profile(df: DataFrame, profile: RecodeProfile) -> DataFrame:
    """One ``withColumns`` for every derived column, then drop skipped ones."""
    cols = set(df.columns)
    present_absent = cols & profile.absent
    if present_absent:
        raise ProfileCoverageError(f"columns expected absent: {sorted(present_absent)}")
    covered = profile.keep | profile.skip | profile.meta | set(profile.derive)
    missing = cols - covered
    if missing:
        raise ProfileCoverageError(f"profile does not cover {sorted(missing)}")
    out = df.withColumns(profile.derive) if profile.derive else df
    return out.drop(*[c for c in profile.skip if c in out.columns and c not in profile.derive])


def regroup_counts(vc: DataFrame, feature: str, new_level: Column,
                   out_feature: str | None = None) -> DataFrame:
    """Value counts of ``feature`` regrouped by a recode of ``level``.

    ``new_level`` is an expression over the column ``level``; levels it maps
    to null are dropped.  Returns ``(feature, level, cnt)``.
    """
    return (vc.where(F.col("feature") == feature)
              .select(F.lit(out_feature or feature).alias("feature"),
                      new_level.alias("level"), "cnt")
              .where(F.col("level").isNotNull())
              .groupBy("feature", "level").agg(F.sum("cnt").alias("cnt")))
