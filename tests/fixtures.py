"""Hand-written raw tables in the original shape (FIXTURES.md §1, §3)."""

from __future__ import annotations

from tierline.functions.lookups import census_region_lookup, state_name_lookup
from tierline.plans.warehouse import Params, Warehouse
from tierline.sources.readers import RawSources
from tierline.sources.schemas import INPATIENT, OUTPATIENT, PHYSICIANS


def _inp(pid, name, city, state, drg, discharges, covered, total, medicare, zipc="35000", hrr="HRR"):
    return (pid, name, "1 Main St", city, state, zipc, hrr, drg, discharges, covered, total, medicare)


INPATIENT_2015 = [
    # provider 10001: padded text, two DRGs, 2015 sum 2000 -> Medium
    _inp(" 10001 ", " ALPHA HOSP ", "Birmingham\t", "AL", "039 - X", 1000, 200.0, 100.0, 80.0),
    _inp("10001", "ALPHA HOSP", "Birmingham", "AL", " 470 Y\n", 1000, 400.0, 300.0, 160.0),
    # provider 10002: two spellings in one year -> fan-out downstream
    _inp("10002", "BETA", "Mobile", "AL", "ABC - X", 600, 100.0, 50.0, 40.0),
    _inp("10002", "BETA INC", "Mobile", "AL", "", 400, 100.0, 70.0, 40.0),
    # 10003: territory -> name = code, region West; exactly 10000 -> Large
    _inp("10003", "GAMMA", "San Juan", "PR", "001 - A", 10000, 300.0, 200.0, 100.0),
    # 10004: DC -> South; 9999 -> Medium
    _inp("10004", "DELTA", "Washington", "DC", "002 - B", 9999, 300.0, 250.0, 100.0),
    # 10005: no state -> left out of dim_region, orphan in the region check
    _inp("10005", "EPSILON", "Nowhere", None, "003 - C", 1999, 300.0, 150.0, None),
    # 10006: covered charges average 0 -> ratio NULL
    _inp("10006", "ZETA", "Dallas", "TX", "004 - D", 10, 0.0, 999999.99, 10.0),
    # dropped rows
    _inp(None, "NOID", "X", "AL", "005 - E", 5, 1.0, 10.0, 1.0),
    _inp("10009", "NODIS", "X", "AL", "005 - E", None, 1.0, 10.0, 1.0),
    _inp("10009", "ZEROPAY", "X", "AL", "005 - E", 5, 1.0, 0.0, 1.0),
    _inp("10009", "NEGPAY", "X", "AL", "005 - E", 5, 1.0, -5.0, 1.0),
    _inp("10009", "MAXPAY", "X", "AL", "005 - E", 5, 1.0, 1000000.0, 1.0),
    _inp("10009", "NULLPAY", "X", "AL", "005 - E", 5, 1.0, None, 1.0),
]

INPATIENT_2014 = [
    # 10001 had other attributes in 2014; dim keeps 2015's
    _inp("10001", "ALPHA OLD NAME", "Old Town", "AL", "039 - X", 5000, 100.0, 90.0, 70.0),
    # 10007: 2014 only, in a state seen only in 2014
    _inp("10007", "ETA", "Houston", "XX", "039 - X", 50, 100.0, 120.0, 60.0),
]

OUTPATIENT_2015 = [
    ("10001", "ALPHA HOSP", "1 Main St", "Birmingham", "AL", 35000, "HRR", "0012", 300, 80.0, 50.0),
    ("10001", "ALPHA HOSP", "1 Main St", "Birmingham", "AL", 35000, "HRR", "0013", 200, 80.0, 2000000.0),
    ("10008", "OUT ONLY", "1 Main St", "Mobile", "AL", 36000, "HRR", "0012", 100, 80.0, 40.0),
    (None, "NOID", "x", "x", "AL", 1, "HRR", "0012", 1, 1.0, 1.0),
    ("10001", "ALPHA HOSP", "1 Main St", "Birmingham", "AL", 35000, "HRR", "0014", 5, 1.0, 0.0),
]


def _phys(npi, state, ptype, cnt, pay, charge):
    return (npi, "Doe", "Jo", "City", state, "35000", "I", ptype, "99213", "Visit", "O",
            cnt, 1.0, cnt, pay, charge, pay, pay)


PHYSICIANS_2014 = [
    _phys("1", "AL", "Cardiology", 10.0, 50.0, 100.0),
    _phys("2", "AL", "Cardiology", 30.0, 70.0, 100.0),
    _phys("2", "AL", "Cardiology", 5.0, 30.0, 50.0),
    _phys(None, "AL", "Cardiology", 5.0, 30.0, 50.0),
    _phys("3", "AL", "Cardiology", 0.0, 30.0, 50.0),
    _phys("4", "AL", "Cardiology", 5.0, 0.0, 50.0),
]


def fixture_warehouse(spark, params: Params | None = None) -> Warehouse:
    raw = RawSources(
        inpatient={
            2015: spark.createDataFrame(INPATIENT_2015, INPATIENT),
            2014: spark.createDataFrame(INPATIENT_2014, INPATIENT),
        },
        outpatient={2015: spark.createDataFrame(OUTPATIENT_2015, OUTPATIENT)},
        physicians={2014: spark.createDataFrame(PHYSICIANS_2014, PHYSICIANS)},
    )
    return Warehouse(
        spark, raw, params or Params(), state_name_lookup(spark), census_region_lookup(spark)
    )
