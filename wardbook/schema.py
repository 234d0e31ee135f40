"""Clinic data model: table schemas, keys, foreign keys, value domains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
RATE = T.DecimalType(5, 4)

_I = T.IntegerType()
_S = T.StringType()
_D = T.DateType()


def _st(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# AppointmentTime is kept as seconds since midnight (int): it round-trips
# through Parquet readers of every engine; `functions.scalars.hhmm` prints it.
SCHEMAS: dict[str, T.StructType] = {
    "Department": _st(("DepartmentID", _I, False), ("DepartmentName", _S, False),
                      ("Location", _S, True), ("Phone", _S, True)),
    "InsuranceProvider": _st(("ProviderID", _I, False), ("ProviderName", _S, False),
                             ("ContactPhone", _S, True), ("ContactEmail", _S, True),
                             ("Address", _S, True), ("CoveragePercent", RATE, False)),
    "Patient": _st(("PatientID", _I, False), ("FirstName", _S, False), ("LastName", _S, False),
                   ("DOB", _D, True), ("Gender", _S, True), ("Phone", _S, True),
                   ("Address", _S, True), ("ProviderID", _I, True)),
    "Doctor": _st(("DoctorID", _I, False), ("FirstName", _S, False), ("LastName", _S, False),
                  ("Specialty", _S, True), ("Phone", _S, True), ("DepartmentID", _I, True)),
    "Nurse": _st(("NurseID", _I, False), ("FirstName", _S, False), ("LastName", _S, False),
                 ("Certification", _S, True), ("Phone", _S, True), ("DepartmentID", _I, True)),
    "HospitalAdmin": _st(("AdminID", _I, False), ("FirstName", _S, False), ("LastName", _S, False),
                         ("Email", _S, True), ("Role", _S, True)),
    "Appointment": _st(("AppointmentID", _I, False), ("PatientID", _I, True), ("DoctorID", _I, True),
                       ("NurseID", _I, True), ("AppointmentDate", _D, True),
                       ("AppointmentTime", _I, True), ("Status", _S, True), ("Purpose", _S, True)),
    "Diagnosis": _st(("DiagnosisID", _I, False), ("AppointmentID", _I, True),
                     ("DiagnosisName", _S, True), ("Notes", _S, True), ("DiagnosisDate", _D, True)),
    "Treatment": _st(("TreatmentID", _I, False), ("DiagnosisID", _I, True),
                     ("AppointmentID", _I, False), ("TreatmentName", _S, True),
                     ("Description", _S, True), ("TreatmentCost", MONEY, False)),
    "BillingRecord": _st(("BillingID", _I, False), ("PatientID", _I, False),
                         ("AppointmentID", _I, False), ("TotalCost", MONEY, False),
                         ("InsuranceCoverage", MONEY, False), ("AmountOwed", MONEY, False),
                         ("AmountPaid", MONEY, False), ("PaymentStatus", _S, False),
                         ("PaymentMethod", _S, True), ("BillingDate", _D, False),
                         ("UpdatedAt", T.TimestampType(), True)),
    "Users": _st(("id", _I, False), ("username", _S, False), ("password_hash", _S, False),
                 ("role", _S, False), ("full_name", _S, True),
                 ("patient_record_id", _I, True), ("linked_record_id", _I, True)),
}

PRIMARY_KEYS: dict[str, str] = {
    "Department": "DepartmentID", "InsuranceProvider": "ProviderID", "Patient": "PatientID",
    "Doctor": "DoctorID", "Nurse": "NurseID", "HospitalAdmin": "AdminID",
    "Appointment": "AppointmentID", "Diagnosis": "DiagnosisID", "Treatment": "TreatmentID",
    "BillingRecord": "BillingID", "Users": "id",
}

# Other unique keys besides the primary key.
UNIQUE_KEYS: dict[str, list[str]] = {
    "BillingRecord": ["AppointmentID"],
    "Users": ["username"],
}

# VARCHAR limits (validation rule V4).
VARCHAR_LIMITS: dict[str, dict[str, int]] = {
    "Department": {"DepartmentName": 50, "Location": 100, "Phone": 15},
    "InsuranceProvider": {"ProviderName": 50, "ContactPhone": 15, "ContactEmail": 100, "Address": 100},
    "Patient": {"FirstName": 50, "LastName": 50, "Gender": 10, "Phone": 15, "Address": 100},
    "Doctor": {"FirstName": 50, "LastName": 50, "Specialty": 50, "Phone": 15},
    "Nurse": {"FirstName": 50, "LastName": 50, "Certification": 50, "Phone": 15},
    "HospitalAdmin": {"FirstName": 50, "LastName": 50, "Email": 100, "Role": 50},
    "Appointment": {"Status": 30, "Purpose": 100},
    "Diagnosis": {"DiagnosisName": 100},
    "Treatment": {"TreatmentName": 100},
    "BillingRecord": {"PaymentStatus": 20, "PaymentMethod": 30},
    "Users": {"username": 255, "password_hash": 255, "role": 50, "full_name": 255},
}

# Column defaults for absent values (rule V5).
DEFAULTS: dict[str, dict[str, object]] = {
    "InsuranceProvider": {"CoveragePercent": "0.7000"},
    "Appointment": {"Status": "Scheduled"},
    "Treatment": {"TreatmentCost": "0.00"},
    "BillingRecord": {"TotalCost": "0.00", "InsuranceCoverage": "0.00", "AmountOwed": "0.00",
                      "AmountPaid": "0.00", "PaymentStatus": "Unpaid"},
}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_column: str
    on_delete: str  # "cascade" or "set_null"; every edge also cascades key updates


FOREIGN_KEYS: list[ForeignKey] = [
    ForeignKey("Patient", "ProviderID", "InsuranceProvider", "ProviderID", "set_null"),
    ForeignKey("Doctor", "DepartmentID", "Department", "DepartmentID", "set_null"),
    ForeignKey("Nurse", "DepartmentID", "Department", "DepartmentID", "set_null"),
    ForeignKey("Appointment", "PatientID", "Patient", "PatientID", "cascade"),
    ForeignKey("Appointment", "DoctorID", "Doctor", "DoctorID", "set_null"),
    ForeignKey("Appointment", "NurseID", "Nurse", "NurseID", "set_null"),
    ForeignKey("Diagnosis", "AppointmentID", "Appointment", "AppointmentID", "cascade"),
    ForeignKey("Treatment", "DiagnosisID", "Diagnosis", "DiagnosisID", "set_null"),
    ForeignKey("Treatment", "AppointmentID", "Appointment", "AppointmentID", "cascade"),
    ForeignKey("BillingRecord", "PatientID", "Patient", "PatientID", "cascade"),
    ForeignKey("BillingRecord", "AppointmentID", "Appointment", "AppointmentID", "cascade"),
]


def topological_order() -> list[str]:
    """Tables ordered parents first along FOREIGN_KEYS."""
    order: list[str] = []
    pending = list(SCHEMAS)
    while pending:
        for t in pending:
            parents = {fk.parent for fk in FOREIGN_KEYS if fk.child == t and fk.parent != t}
            if parents <= set(order):
                order.append(t)
                pending.remove(t)
                break
        else:  # pragma: no cover - the graph is a DAG
            raise ValueError("foreign keys form a cycle")
    return order


# Fixed value domains.
APPOINTMENT_STATUSES = ["Requested", "Scheduled", "Completed", "Canceled"]
PAYMENT_STATUSES = ["Unpaid", "Partial", "Paid", "Canceled"]
PAYMENT_METHODS = ["Cash", "Card", "Insurance", "Waived"]
ROLES = ["admin", "doctor", "receptionist", "patient", "nurse"]
UNINSURED_COVERAGE = "0.70"
