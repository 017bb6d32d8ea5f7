"""Fixed values of the workforce analyses.

Everything in the "fixed values" block must stay exactly as written: the
analyses compare against these literals, so changing one changes results.
"""

from __future__ import annotations

# --- fixed values (must equal the studied analysis) --------------------------
# Year of the termination date that marks "not terminated".
NOT_TERMINATED_YEAR = 1900
# Termination reason that means "no reason".
NO_REASON = "Not Applicable"
# Employment status values.
STATUS_ACTIVE = "ACTIVE"
STATUS_TERMINATED = "TERMINATED"
# Action labels of the hire / termination event tables.
ACTION_HIRED = "hired"
ACTION_TERMED = "termed"
# Length of the average year used to turn a day count into whole years.
DAYS_PER_YEAR = 365.25
# Age bands: (exclusive upper bound, label); ages of 90 and over get no band.
AGE_BANDS = [
    (20, "<20"),
    (30, "20-29"),
    (40, "30-39"),
    (50, "40-49"),
    (60, "50-59"),
    (70, "60-69"),
    (80, "70-79"),
    (90, "80-89"),
]
# Whisker reach of the box statistics, in inter-quartile ranges.
WHISKER_COEF = 1.5
# Confidence level of the band around a fitted line.
BAND_LEVEL = 0.95
# Gender codes in level order and the names their pivot columns get.
GENDER_COLUMNS = [("F", "Female"), ("M", "Male")]
# Column of every other gender code and of missing ones.
OTHER_GENDER = "Other"
# Date text format of the raw CSV (month/day/year, trailing text ignored).
RAW_DATE_FORMAT = "M/d/yyyy"
# Text that stands for a missing value in the raw CSV.
RAW_NULL_TEXT = "NA"
# -----------------------------------------------------------------------------

ID = "EmployeeID"
SNAPSHOT = "snapshot_id"
RECORD_DATE = "recorddate_key"
BIRTH_DATE = "birthdate_key"
HIRE_DATE = "orighiredate_key"
TERM_DATE = "terminationdate_key"
AGE = "age"
SERVICE_YEARS = "length_of_service"
SERVICE = "service"
CITY = "city_name"
DEPT = "department_name"
JOB = "job_title"
STORE = "store_name"
GENDER = "gender_short"
GENDER_FULL = "gender_full"
REASON = "termreason_desc"
TERM_TYPE = "termtype_desc"
STATUS_YEAR = "STATUS_YEAR"
STATUS = "STATUS"
BU = "BUSINESS_UNIT"
AGE_BAND = "agegroup"       # derived column of the band reports
