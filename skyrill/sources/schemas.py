"""Input schemas: alerts and photometry tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names of an alert's candidate record, by type; the first group of each type defaults to 0.
DEFAULTED = {
    "double": "jd ra dec ranr decnr",
    "float": "magpsf sigmapsf",
    "int": "fid programid ndethist ncovhist nmtchps",
    "long": "pid candid",
}
OPTIONAL = {
    "double": "jdstarthist scorr",
    "string": "programpi ssnamenr",
    "int": "nid rcid field nneg nbad",
    "float": (
        "diffmaglim chipsf magap sigmagap distnr magnr sigmagnr chinr sharpnr sky fwhm classtar mindtoedge seeratio aimage bimage elong rb ssdistnr ssmagnr "
        "sgmag1 srmag1 simag1 szmag1 sgscore1 distpsnr1 sgmag2 srmag2 simag2 szmag2 sgscore2 distpsnr2 sgmag3 srmag3 simag3 szmag3 sgscore3 distpsnr3 "
        "dsnrms ssnrms dsdiff magzpsci magzpsciunc magzpscirms zpmed exptime drb clrcoeff clrcounc neargaia maggaia neargaiabright maggaiabright"
    ),
}
REQUIRED = {"float": "psfFlux psfFluxErr snr", "string": "band"}

_TYPES = {"double": T.DoubleType(), "float": T.FloatType(), "int": T.IntegerType(), "long": T.LongType(), "string": T.StringType()}


def _fields(*groups: dict[str, str]) -> list[T.StructField]:
    return [T.StructField(name, _TYPES[kind]) for g in groups for kind, names in g.items() for name in names.split()]


#: A point under both of its spellings; ``isdiffpos`` comes in four encodings and is read as text.
POINT = T.StructType(_fields({"double": "time jd", "float": "mag magpsf mag_err sigmapsf", "string": "band"}))
CANDIDATE = T.StructType([*_fields(DEFAULTED, OPTIONAL, REQUIRED), T.StructField("isdiffpos", T.StringType())])
ALERT = T.StructType(
    [
        T.StructField("_id", T.LongType()),
        T.StructField("objectId", T.StringType()),
        T.StructField("candidate", CANDIDATE),
        T.StructField("prv_candidates", T.ArrayType(POINT)),
        T.StructField("fp_hists", T.ArrayType(POINT)),
    ]
)
BUNDLE = "map<string, struct<classification: string, probability: double, photometry: array<array<string>>>>"
