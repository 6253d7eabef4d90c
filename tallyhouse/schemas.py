"""Table schemas and the description of the three service exports.

Raw exports are text only; blanks in column names are kept as they come and are renamed in the first projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


PANTRY_EXPORT = _strings("Client ID", "Visit Date")
PHARMACY_EXPORT = _strings("PAT KEY", "RX PICKED UP")
CLINIC_EXPORT = _strings("patientid", "apptcheckindate")

DEMOGRAPHIC_FIELDS = (
    "sex_at_birth",
    "gender_identity",
    "ethnicity",
    "race",
    "primary_language",
    "marital_status",
)
NAME_FIELDS = ("first_name", "last_name")
# What an export can tell about a person; `dob` is a date, the others are text.
PERSON_FIELDS = (*NAME_FIELDS, "dob", *DEMOGRAPHIC_FIELDS)

# Export ids take all of unsigned 64 bits, and ids made from them a little more. Tables may hold ids in any integral type or as
# decimals; the merges write this one.
ID = T.DecimalType(20, 0)
PERSON = T.StructType(
    [
        T.StructField("person_id", T.LongType()),
        T.StructField("pantry_client_id", T.LongType()),
        T.StructField("pharmacy_pat_key", T.LongType()),
        T.StructField("clinic_patientid", T.LongType()),
        *[T.StructField(f, T.DateType() if f == "dob" else T.StringType()) for f in PERSON_FIELDS],
    ]
)

HOUSEHOLD = T.StructType([T.StructField("household_id", T.LongType()), T.StructField("person_id", T.LongType())])

PERSON_AUDIT = T.StructType(
    [
        T.StructField("person_id", ID),
        T.StructField("source", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("old_value", T.StringType()),
        T.StructField("new_value", T.StringType()),
    ]
)


@dataclass(frozen=True)
class ServiceExport:
    """Where one service keeps its id and date, and which `person` column holds that id."""

    service: str
    table: str
    id_column: str
    date_column: str
    person_key: str


SERVICES = (
    ServiceExport("pantry", "pantry_export", "Client ID", "Visit Date", "pantry_client_id"),
    ServiceExport("pharmacy", "pharmacy_pickup_date_export", "PAT KEY", "RX PICKED UP", "pharmacy_pat_key"),
    ServiceExport("clinic", "clinic_dob_export", "patientid", "apptcheckindate", "clinic_patientid"),
)
