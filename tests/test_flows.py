"""Treatment write flows: add a batch of requests, remove treatments."""

from decimal import Decimal

from wardbook.operators.flows import add_treatments, remove_treatments


def test_add_treatments(spark, seed):
    reqs = spark.createDataFrame([
        (1, '{"AppointmentID": 5, "TreatmentCost": 40.00, "TreatmentName": "x"}'),
        (2, '[{"AppointmentID": "9", "DiagnosisID": "", "TreatmentCost": "10"}, {"AppointmentID": 9, "TreatmentCost": 5}]'),
        (3, '[{"AppointmentID": 4, "TreatmentCost": 99}, {"TreatmentCost": 1}]'),
        (4, '{"AppointmentID": 4, "TreatmentCost": '),
        (5, '{"AppointmentID": 999, "TreatmentCost": 7}'),
        (6, '{"AppointmentID": 4, "DiagnosisID": 777, "TreatmentCost": 7}'),
        (7, '[]'), (8, None), (9, '{"AppointmentID": 4, "TreatmentCost": null}'),
        (10, '{"AppointmentID": 4, "TreatmentCost": "seven"}'), (11, '{"AppointmentID": 4, "TreatmentCost": 1e12}'),
        (12, '{"AppointmentID": "four"}'), (13, '{"AppointmentID": 4, "DiagnosisID": "x"}'),
        (14, '{"AppointmentID": 4, "TreatmentName": "' + "n" * 101 + '"}'), (15, '[{"AppointmentID": 4}, 5]'),
    ], "request_id int, body string")
    out, rejected = add_treatments(seed, reqs)
    assert {r["request_id"]: r["reason"] for r in rejected.collect()} == {
        3: "appointment missing", 4: "body not readable", 5: "AppointmentID has no Appointment",
        6: "DiagnosisID has no Diagnosis", 7: "no items", 8: "body not readable", 9: "cost is null",
        10: "cost not an amount", 11: "cost not an amount", 12: "appointment missing",
        13: "diagnosis not a number", 14: "TreatmentName longer than 100", 15: "body not readable"}
    new = out["Treatment"].filter("TreatmentID > 30").orderBy("TreatmentID").collect()
    assert [(r["TreatmentID"], r["AppointmentID"]) for r in new] == [(31, 5), (32, 9), (33, 9)]
    bills = {r["AppointmentID"]: r for r in out["BillingRecord"].collect()}
    assert bills[5]["TotalCost"] == Decimal("160.00") and bills[9]["TotalCost"] == Decimal("415.00")
    assert bills[4]["TotalCost"] == Decimal("50.00")  # the rejected request changed nothing
    assert bills[5]["AmountPaid"] == Decimal("20.00")  # payments are kept
    assert len(bills) == 30


def test_remove_treatments(spark, seed):
    keys = spark.createDataFrame([(2,)], "TreatmentID int")
    out = remove_treatments(seed, keys)
    assert out["Treatment"].count() == 29
    b = {r["AppointmentID"]: r for r in out["BillingRecord"].collect()}[2]
    assert b["TotalCost"] == Decimal("0.00") and b["PaymentStatus"] == "Paid"
    assert b["AmountPaid"] == Decimal("25.00")


def test_book_appointments(spark, seed):
    import datetime as dt
    from wardbook.operators.flows import book_appointments
    d = dt.date(2026, 7, 1)
    reqs = spark.createDataFrame([
        (1, "receptionist", None, 3, 2, 5, d, 36000, None, "check"),    # staff booking
        (2, "patient", 12, 99, 4, None, d, 36000, "Completed", "pain"),  # own record, portal nurse
        (3, "patient", None, 5, 4, None, d, 36000, None, "x"),           # no patient record
        (4, "doctor", None, 3, 77, None, d, 36000, "Scheduled", "y"),    # unknown doctor
    ], "seq int, role string, patient_record_id int, PatientID int, DoctorID int, NurseID int, "
       "AppointmentDate date, AppointmentTime int, Status string, Purpose string")
    out, rejected = book_appointments(seed, reqs)
    assert {r["seq"]: r["reason"] for r in rejected.collect()} == {
        3: "no linked patient record", 4: "DoctorID has no Doctor"}
    new = {r["AppointmentID"]: r for r in out["Appointment"].filter("AppointmentID > 30").collect()}
    assert sorted(new) == [31, 32]
    assert (new[31]["PatientID"], new[31]["Status"], new[31]["NurseID"]) == (3, "Scheduled", 5)
    # doctor 4 works in department 2, whose first nurse is 4
    assert (new[32]["PatientID"], new[32]["Status"], new[32]["NurseID"]) == (12, "Requested", 4)
