"""The recode profile of the census person files (O24), for a version and a mode.

``full`` mode keeps what the 2010-geography files hold; ``common`` mode keeps
only what old (2000-geography) and new files share, in the old files' codes.
A profile covers the features of its version exactly: every real, discrete
column and allocation flag is kept, derived from or left out, and columns of
the other era must be absent.  Rows are recoded first and stats are taken
from the recoded rows, so both agree.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regemb import census
from regemb.functions import recode as R
from regemb.spec import MicrodataSpec

# FIXED VALUES: which columns of the person files the profile keeps, by topic.

KEPT = {
    "person": "AGEP SEX",
    "citizenship": "CIT DECADE NATIVITY NOP",
    "work": "COW ESR ESP WKHP WKL WKW NAICSP OCCP",
    "commute": "JWDP JWMNP JWRIP JWTR",
    "income": "INTP OIP PAP RETP SEMP SSIP SSP WAGP PERNP PINCP POVPIP",
    "children": "FER PAOC GCL GCM GCR",
    "school": "SCH SCHG SCHL",
    "marriage": "MSP",
    "language": "ENG LANX LANP",
    "migration": "MIG WAOB",
    "military": "MIL VPS",
    "origin": "HISP RAC1P RAC2P RACAIAN RACASN RACBLK RACSOR RACWHT RACNUM ANC1P",
}
# only in the new files; kept in full mode
KEPT_IF_FULL = {
    "citizenship": "CITWP",
    "work": "WRK",
    "school": "SCIENGP SCIENGRLP FOD1P",
    "disability": "DDRS DEAR DEYE DOUT DPHY DREM DRAT DRATX DIS",
    "marriage": "MARHT MARHD MARHM MARHW MARHYP",
    "insurance": "HICOV PRIVCOV PUBCOV",
}
# in both eras; kept in full mode
KEPT_IF_FULL_BOTH = "RAC3P"
# one of the two spellings, by version
PACIFIC = ("RACNHPI", "RACNH RACPI")
LEFT_OUT = {
    "person": "QTRBIR",
    "household": "RELP OC RC SFN SFR",
    "citizenship": "YOEP",
    "work": "NWAB NWAV NWLA NWLK NWRE",
    "commute": "JWAP DRIVESP POWPUMA POWSP",
    "marriage": "MAR",
    "migration": "MIGPUMA MIGSP POBP",
    "military": "MLPA MLPB MLPE MLPH MLPI MLPJ MLPK",
    "origin": "ANC ANC2P",
}
LEFT_OUT_NEW = {
    "work": "INDP SOCP",
    "school": "FOD2P",
    "insurance": "HINS1 HINS2 HINS3 HINS4 HINS5 HINS6 HINS7",
    "military": "MLPCD MLPFG",
}
LEFT_OUT_OLD = {
    "work": "indp02 indp07 socp00 socp10 naicsp02 naicsp07 occp02 occp10",
    "military": "MLPC MLPD MLPF MLPG",
}
DERIVED = ("ANYHISP", "ETHNICITY", "HASDEGREE")
# ---------------------------------------------------------------------------


def _all(topics: dict[str, str]) -> set[str]:
    return {c for text in topics.values() for c in text.split()}


@dataclass
class CensusProfile:
    """A profile with the spec of its output and the joins it needs first."""

    spec: MicrodataSpec          # of the rows that come out
    profile: R.RecodeProfile
    degree_columns: tuple[str, ...] = ()
    degree_lookup: DataFrame | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """Recode the rows: a preprocessor (X1) for ``featurize``."""
        for c in self.degree_columns:
            df = R.degree_category_join(df, c, self.degree_lookup)
        out = R.apply_profile(df, self.profile)
        # a derived column may replace one that is left out under its own name
        return out


def is_old(spec: MicrodataSpec) -> bool:
    return spec.geo_year == "00"


def census_profile(version: str, common: bool = False, also_keep: tuple[str, ...] = (),
                   degree_lookup: DataFrame | None = None,
                   other_columns: tuple[str, ...] = ("region", "batch")) -> CensusProfile:
    """O24 of a person-file version.

    ``also_keep`` names left-out columns to keep after all (``ANC2P`` is then
    recoded like ``ANC1P``); ``degree_lookup`` is the field-of-degree table
    (S11), needed where ``FOD1P`` is kept; ``other_columns`` may be in the
    input besides the spec's and pass through.
    """
    spec = census.version(version)
    old = is_old(spec)
    if old and not common:
        raise ValueError(f"{version} has 2000 geography: its profile is the common one")
    features = set(spec.features)

    keep = _all(KEPT) | set(PACIFIC[0 if PACIFIC[0] in features else 1].split())
    skip, absent = _all(LEFT_OUT), set()
    only_new, full = _all(KEPT_IF_FULL), set(KEPT_IF_FULL_BOTH.split())
    if old:
        skip |= _all(LEFT_OUT_OLD) | full
        absent |= _all(LEFT_OUT_NEW) | only_new | {"INDP", "SOCP"}
    else:
        skip |= _all(LEFT_OUT_NEW)
        absent |= _all(LEFT_OUT_OLD)
        (skip if common else keep).update(only_new | full)
    skip |= set(spec.alloc)
    wanted = set(also_keep)
    if wanted - skip - keep:
        raise ValueError(f"not in {version}: {sorted(wanted - skip - keep)}")
    keep, skip = keep | wanted, skip - wanted

    derive = {
        "ANYHISP": R.any_hispanic("HISP"),
        "ETHNICITY": R.ethnicity("HISP", "RAC1P"),
        "HASDEGREE": R.has_degree("SCHL", R.DEGREE_CUTOFF_NEW)}
    ancestry = [c for c in ("ANC1P", "ANC2P") if c in keep]
    if old:
        derive |= {"NAICSP": R.industry_sector(R.first_present("naicsp07", "naicsp02")),
                   "OCCP": R.occupation_group(R.first_present("occp10", "occp02")),
                   "HASDEGREE": R.has_degree("SCHL", R.DEGREE_CUTOFF_COMMON),
                   "MIL": R.remap("MIL", R.MIL_OLD_TO_NEW),
                   "LANP": R.remap("LANP", R.LANP_OLD_TO_COMMON, identity_default=True),
                   **{c: R.remap(c, R.ANCP_OLD_TO_COMMON, identity_default=True)
                      for c in ancestry},
                   "RAC2P": R.remap("RAC2P", R.RAC2P_OLD)}
    else:
        derive |= {"NAICSP": R.industry_sector("NAICSP"), "OCCP": R.occupation_group("OCCP")}
        if common:
            schl = R.remap("SCHL", R.SCHL_NEW_TO_OLD)
            derive |= {"SCHL": schl, "HASDEGREE": R.has_degree(schl, R.DEGREE_CUTOFF_COMMON),
                       "SCHG": R.remap("SCHG", R.SCHG_NEW_TO_OLD),
                       "FER": R.remap("FER", R.FER_NEW_TO_OLD),
                       "LANP": R.remap("LANP", R.LANP_NEW_TO_OLD, identity_default=True),
                       **{c: R.remap(c, R.ANCP_NEW_TO_OLD, identity_default=True)
                          for c in ancestry},
                       "RAC2P": R.remap("RAC2P", R.RAC2P_NEW)}
    made = set(DERIVED) | ({"NAICSP", "OCCP"} if old else set())
    _check_cover(version, features, keep - made, skip, absent)

    degree = tuple(c for c in ("FOD1P", "FOD2P") if c in keep)
    if degree and degree_lookup is None:
        raise ValueError(f"{', '.join(degree)}: give the field-of-degree table")
    out_spec = replace(
        spec, name=f"{version}_{'common' if common else 'full'}",
        real=tuple(c for c in spec.real if c in keep),
        discrete=tuple(sorted({c for c in spec.discrete if c in keep} | made)), alloc=(),
        adjust={}, drops=(), renames={}, era_subset=False)
    passed = (set(spec.meta) | set(spec.weights) | spec.adjust_columns() | set(other_columns))
    return CensusProfile(out_spec, R.RecodeProfile(derive=derive, keep=keep - set(derive),
                                                   skip=skip - set(derive), absent=absent,
                                                   meta=passed), degree, degree_lookup)


def _check_cover(version: str, features: set[str], keep: set[str], skip: set[str],
                 absent: set[str]) -> None:
    """Every feature is kept or left out, once, and nothing else is named."""
    wrong = {"neither kept nor left out": features - keep - skip,
             "kept and left out": keep & skip,
             "not in the file": (keep | skip) - features,
             "expected absent": absent & features}
    found = {k: sorted(v) for k, v in wrong.items() if v}
    if found:
        raise R.ProfileCoverageError(f"profile of {version}: {found}")


def code_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, level, n`` of some recoded columns, nulls as a level of their own."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level"))
                        for c in columns])
    return df.select(F.inline(entries)).groupBy("feature", "level").agg(
        F.count(F.lit(1)).alias("n"))
