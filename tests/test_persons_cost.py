"""What is done once an id, or once a reference, and not once a row or a use."""

from concord.config import config
from concord.operators import canonical
from concord.plans import linkage

ROWS = [("1", 1, "Ásha", "Rao", "Pune", "+1 555 123 4567", " h1 "), ("1", 2, "Asha", "Rao", "PUNE ", "(555) 1234567", "h24"), ("2", 3, "asha", "rao", "pune", None, "h2"), ("1", 4, "x", "y", None, "12", None)]
SCHEMA = "vid string, seq int, first_name string, last_name string, city string, phone_1 string, hco_vid string"


def test_texts_are_normalised_after_rows_are_collapsed(spark):
    canon = canonical.persons(spark.createDataFrame(ROWS, SCHEMA), config())
    below = canon._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[-1]
    assert "translate(" not in below and "regexp_replace(" not in below
    got = {r.vid: (r.name_canon, r.cities, r.phones, r.hco_vids) for r in canon.collect()}
    assert got == {"1": ("asha rao", ["pune"], ["5551234567"], ["h1", "h24"]), "2": ("asha rao", ["pune"], [], ["h2"])}


def test_lookup_reads_its_reference_once(spark):
    form = {"first_name": "Asha", "last_name": "Rao", "city": "Pune", "city_cda": ""}
    found = linkage.lookup(form, spark.createDataFrame(ROWS, SCHEMA), config({"blocking": {"cap": None}}))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert [r.vid_b for r in found.collect()] == ["1", "2"]
