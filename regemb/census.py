"""Census person/housing file versions as ``MicrodataSpec`` instances (D3).

Column roles of each published file version.  Lists are sorted (levels and
catalogue order follow this order); the 80 replicate weights follow the rule
``<weight>1 .. <weight>80`` and are carried, never used.
"""

from __future__ import annotations

from dataclasses import replace

from regemb.spec import MicrodataSpec


def _s(text: str) -> tuple[str, ...]:
    return tuple(sorted(text.split()))


def _replicates(w: str) -> tuple[str, ...]:
    return tuple(f"{w}{i}" for i in range(1, 81))


# ---------------------------------------------------------------------------
# FIXED VALUES: column names of the published file versions.

_ADJINC_2006 = "INTP OIP PAP PERNP PINCP RETP SEMP SSIP SSP WAGP"

V2006_DISCRETE = """
    CIT COW ENG FER GCL GCM GCR JWRIP JWTR LANX MAR MIG MIL MLPA MLPB
    MLPC MLPD MLPE MLPF MLPG MLPH MLPI MLPJ MLPK NWAB NWAV NWLA NWLK
    NWRE RELP SCH SCHG SCHL SEX WKL WKW ANC ANC1P ANC2P DECADE DRIVESP
    ESP ESR HISP indp02 indp07 LANP MIGPUMA MIGSP MSP naicsp02 naicsp07
    NATIVITY NOP OC occp02 occp10 PAOC POBP POWPUMA POWSP QTRBIR RAC1P
    RAC2P RAC3P RACAIAN RACASN RACBLK RACNHPI RACSOR RACWHT RC SFN SFR
    socp00 socp10 VPS WAOB"""
V2006_ALLOC = """
    FAGEP FANCP FCITP FCOWP FENGP FESRP FFERP FGCLP FGCMP FGCRP
    FHISP FINDP FINTP FJWDP FJWMNP FJWRIP FJWTRP FLANP FLANXP FMARP
    FMIGP FMIGSP FMILPP FMILSP FOCCP FOIP FPAP FPOBP FPOWSP FRACP
    FRELP FRETP FSCHGP FSCHLP FSCHP FSEMP FSEXP FSSIP FSSP FWAGP
    FWKHP FWKLP FWKWP FYOEP"""
V2006_REAL = """
    AGEP INTP JWMNP OIP PAP RETP SEMP SSIP SSP WAGP WKHP YOEP JWAP
    JWDP PERNP PINCP POVPIP RACNUM"""

V2010_ALLOC = """
    FAGEP FCITP FCITWP FCOWP FDDRSP FDEARP FDEYEP FDOUTP FDPHYP
    FDRATP FDRATXP FDREMP FENGP FESRP FFERP FFODP FGCLP FGCMP FGCRP
    FHINS1P FHINS2P FHINS3C FHINS3P FHINS4C FHINS4P FHINS5C FHINS5P
    FHINS6P FHINS7P FHISP FINDP FINTP FJWDP FJWMNP FJWRIP FJWTRP
    FLANP FLANXP FMARHDP FMARHMP FMARHTP FMARHWP FMARHYP FMARP FMIGP
    FMIGSP FMILPP FMILSP FOCCP FOIP FPAP FPOBP FPOWSP FRACP FRELP
    FRETP FSCHGP FSCHLP FSCHP FSEMP FSEXP FSSIP FSSP FWAGP FWKHP
    FWKLP FWKWP FWRKP FYOEP"""
V2010_DISCRETE = """
    CIT COW DDRS DEAR DEYE DOUT DPHY DRAT DRATX DREM ENG FER GCL GCM
    GCR HINS1 HINS2 HINS3 HINS4 HINS5 HINS6 HINS7 JWRIP JWTR LANX
    MAR MARHD MARHM MARHT MARHW MARHYP MIG MIL MLPA MLPB MLPCD MLPE
    MLPFG MLPH MLPI MLPJ MLPK NWAB NWAV NWLA NWLK NWRE RELP SCH SCHG
    SCHL SEX WKL WKW WRK ANC ANC1P ANC2P DECADE DIS DRIVESP ESP ESR
    FOD1P FOD2P HICOV HISP INDP LANP MIGPUMA MIGSP MSP NAICSP NATIVITY
    NOP OC OCCP PAOC POBP POWPUMA POWSP PRIVCOV PUBCOV QTRBIR RAC1P
    RAC2P RAC3P RACAIAN RACASN RACBLK RACNHPI RACSOR RACWHT RC SCIENGP
    SCIENGRLP SFN SFR SOCP VPS WAOB"""
V2010_REAL = """
    AGEP CITWP INTP JWMNP OIP PAP RETP SEMP SSIP SSP WAGP WKHP YOEP
    JWAP JWDP PERNP PINCP POVPIP RACNUM"""
V2010_DROPS = """
    ANC1P05 ANC2P05 FANCP LANP05 MARHYP05 MIGPUMA00 MIGSP05 POBP05
    POWPUMA00 POWSP05 RAC2P05 RAC3P05 SOCP10 YOEP05 CITWP05 OCCP10"""
V2010_RENAMES = {
    "ANC1P12": "ANC1P", "ANC2P12": "ANC2P", "LANP12": "LANP", "MARHYP12": "MARHYP",
    "MIGPUMA10": "MIGPUMA", "MIGSP12": "MIGSP", "OCCP12": "OCCP", "POBP12": "POBP",
    "POWPUMA10": "POWPUMA", "POWSP12": "POWSP", "RAC2P12": "RAC2P", "RAC3P12": "RAC3P",
    "SOCP12": "SOCP", "YOEP12": "YOEP", "CITWP12": "CITWP",
}
V2011_EXTRA_ALLOC = "FDISP FPINCP FPUBCOVP FPERNP FPRIVCOVP"

V2012_ALLOC = """
    FAGEP FANCP FCITP FCITWP FCOWP FDDRSP FDEARP FDEYEP FDISP FDOUTP
    FDPHYP FDRATP FDRATXP FDREMP FENGP FESRP FFERP FFODP FGCLP FGCMP
    FGCRP FHINS1P FHINS2P FHINS3C FHINS3P FHINS4C FHINS4P
    FHINS5C FHINS5P FHINS6P FHINS7P FHISP FINDP FINTP FJWDP FJWMNP
    FJWRIP FJWTRP FLANP FLANXP FMARHDP FMARHMP FMARHTP FMARHWP FMARHYP
    FMARP FMIGP FMIGSP FMILPP FMILSP FOCCP FOIP FPAP FPERNP FPINCP
    FPOBP FPOWSP FPRIVCOVP FPUBCOVP FRACP FRELP FRETP FSCHGP FSCHLP
    FSCHP FSEMP FSEXP FSSIP FSSP FWAGP FWKHP FWKLP FWKWP FWRKP
    FYOEP"""
V2012_DISCRETE = """
    CIT COW DDRS DEAR DEYE DOUT DPHY DRAT DRATX DREM ENG FER GCL GCM
    GCR HINS1 HINS2 HINS3 HINS4 HINS5 HINS6 HINS7 JWRIP JWTR LANX MAR
    MARHD MARHM MARHT MARHW MARHYP MIG MIL MLPA MLPB MLPCD MLPE MLPFG
    MLPH MLPI MLPJ MLPK NWAB NWAV NWLA NWLK NWRE RELP SCH SCHG SCHL SEX
    WKL WKW WRK ANC ANC1P ANC2P DECADE DIS DRIVESP ESP ESR FOD1P FOD2P
    HICOV HISP INDP LANP MIGPUMA MIGSP MSP NAICSP NATIVITY NOP OC OCCP
    PAOC POBP POWPUMA POWSP PRIVCOV PUBCOV QTRBIR RAC1P RAC2P RAC3P
    RACAIAN RACASN RACBLK RACNH RACPI RACSOR RACWHT RC SCIENGP SCIENGRLP
    SFN SFR SOCP VPS WAOB"""
V2012_REAL = """
    AGEP CITWP INTP JWMNP OIP PAP RETP SEMP SSIP SSP WAGP WKHP YOEP JWAP
    JWDP PERNP PINCP POVPIP RACNUM"""
V2013_EXTRA_ALLOC = "FHICOVP"
V2013_DROPS = "REGION DIVISION"

H2014_ALLOC = """
    FACCESSP FACRP FAGSP FBATHP FBDSP FBLDP FBROADBNDP FCOMPOTHXP
    FBUSP FCONP FDIALUPP FELEP FFINCP FFSP FFULP FGASP FGRNTP
    FHFLP FHINCP FHISPEEDP FHOTWATP FINSP FKITP FLAPTOPP FMHP FMRGIP
    FMRGP FMRGTP FMRGXP FMVP FOTHSVCEXP FPLMP FPLMPRP FREFRP FRMSP
    FRNTMP FRNTP FRWATP FRWATPRP FSATELLITEP FSINKP FSMARTPHONP
    FSMOCP FSMP FSMXHP FSMXSP FSTOVP FTABLETP FTAXP FTELP FTENP
    FTOILP FVACSP FVALP FVEHP FWATP FYBLP"""
H2014_DISCRETE = """
    NP TYPE
    ACCESS ACR AGS BATH BDSP BLD BUS BROADBND COMPOTHX DIALUP
    FS HFL HISPEED HOTWAT LAPTOP
    MRGI MRGT MRGX OTHSVCEX REFR RMSP RNTM RWAT RWATPR
    SATELLITE SINK SMARTPHONE STOV TABLET TEL TEN TOIL VACS
    VEH YBL FES
    FPARC
    HHL HHT HUGCL HUPAC HUPAOC HUPARC KIT LNGI MULTG
    MV NOC NPF NPP NR NRC PARTNER PLM PLMPRP PSF R18 R60 R65
    RESMODE SMX SRNT SSMC SVAL WIF WKEXREL WORKSTAT
    ELEFP FULFP GASFP WATFP"""
H2014_REAL = "VALP GRPIP OCPIP"
H2014_ADJHSG = """
    CONP ELEP FULP GASP INSP MHP MRGP RNTP SMP WATP
    GRNTP SMOCP TAXAMT"""
H2014_ADJINC = "FINCP HINCP"
H2014_DROPS = "DIVISION REGION"
# ---------------------------------------------------------------------------

_PW = ("PWGTP",)


def _person(name, meta, discrete, alloc, real, geo, drops="", renames=None,
            era_subset=False, key="SERIALNO", lower_renames=False):
    return MicrodataSpec(
        name=name, weight="PWGTP", extra_weights=_replicates("PWGTP"),
        meta=_s(meta), discrete=_s(discrete), alloc=_s(alloc), real=_s(real),
        adjust={"ADJINC": _s(_ADJINC_2006)}, drops=_s(drops) if drops else (),
        renames=dict(renames or {}), geo_year=geo, era_subset=era_subset, key=key)


V2006_10 = _person("2006-10", "RT SPORDER serialno PUMA ST", V2006_DISCRETE, V2006_ALLOC,
                   V2006_REAL, "00", key="serialno")
V2007_11 = replace(V2006_10, name="2007-11")
V2010_14 = _person("2010-14_12-14", "RT SPORDER serialno PUMA ST", V2010_DISCRETE, V2010_ALLOC,
                   V2010_REAL, "10", drops=V2010_DROPS, renames=V2010_RENAMES, era_subset=True,
                   key="serialno")
V2011_15 = replace(V2010_14, name="2011-15_12-15",
                   alloc=tuple(sorted(V2010_14.alloc + _s(V2011_EXTRA_ALLOC))))
V2012_16 = _person("2012-16", "RT SPORDER SERIALNO PUMA ST", V2012_DISCRETE, V2012_ALLOC,
                   V2012_REAL, "10",
                   renames={f"pwgtp{i}": f"PWGTP{i}" for i in range(1, 81)})
V2013_17 = replace(V2012_16, name="2013-17",
                   alloc=tuple(sorted(V2012_16.alloc + _s(V2013_EXTRA_ALLOC))),
                   drops=_s(V2013_DROPS))
V2014_18 = replace(V2013_17, name="2014-18")
V2015 = replace(V2013_17, name="2015")

H2014_18 = MicrodataSpec(
    name="housing_2014-18", weight="WGTP", extra_weights=_replicates("WGTP"),
    meta=_s("RT SERIALNO PUMA ST"), alloc=_s(H2014_ALLOC), discrete=_s(H2014_DISCRETE),
    real=tuple(sorted(set(_s(H2014_REAL)) | set(_s(H2014_ADJHSG)) | set(_s(H2014_ADJINC)))),
    adjust={"ADJHSG": _s(H2014_ADJHSG), "ADJINC": _s(H2014_ADJINC)},
    drops=_s(H2014_DROPS), geo_year="10", key="SERIALNO")

VERSIONS: dict[str, MicrodataSpec] = {
    s.name: s for s in (V2006_10, V2007_11, V2010_14, V2011_15, V2012_16, V2013_17,
                        V2014_18, V2015, H2014_18)
}


def version(name: str, with_housing: bool = False) -> MicrodataSpec:
    """A file version, optionally extended by its housing partner."""
    spec = VERSIONS[name]
    if with_housing:
        spec = spec.with_housing(VERSIONS[f"housing_{name}"])
    return spec
