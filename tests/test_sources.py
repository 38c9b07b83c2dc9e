import zipfile

import pytest
from pyspark.sql import functions as F

from concord.config import config
from concord.plans import batch
from concord.sources import excel, files, schema, sinks
from concord.streaming import requests


def test_header_and_names(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("report 7,,\n2024,1,2\nfirst name,last name,\"e-mail, work\",\nasha,rao,a@b.cd,\n,,,\nNA,x,,\n")
    df, at = files.read_with_header(spark, str(path))
    assert at == 2 and df.columns == ["first name", "last name", "e-mail, work"] and df.count() == 2
    assert files.unique_names(["a", "a", "b", "a"]) == ["a", "a_2", "b", "a_3"]
    found = schema.detect(df.columns)
    assert found["first_name"] == ["first name"] and found["email"] == ["e-mail, work"] and "specialty" in schema.missing_signals(found)
    assert schema.resolve(["VID", "Org Name", "x"], {"vid": ["vid"], "name": ["name"]}, {"name": [["name"]]}) == {"vid": "VID", "name": "Org Name"}


def test_text_and_zip(spark, tmp_path):
    (tmp_path / "y.csv").write_text("id,n\n900000000000000001,NA\n2,x\n")
    rows = files.read_text_table(spark, str(tmp_path / "y.csv")).collect()
    assert rows[0].id == "900000000000000001" and rows[0].n is None
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("d.csv", "a,a\n1,2\n")
    assert files.read_zip(spark, str(tmp_path / "z.zip")).collect()[0].asDict() == {"a": "1", "a_2": "2"}
    assert files.newest(spark, str(tmp_path / "*.csv")).endswith(".csv")


def test_sinks_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "AUTO")], "id long, n string, classification string")
    assert sinks.write_tables({"a": df, "b": df.limit(0)}, str(tmp_path / "o"), "csv") == ["a"]
    sinks.append_by_class(df, str(tmp_path / "p"))
    sinks.append_by_class(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert sinks.as_text(df, ["id"]).dtypes[0] == ("id", "string")
    events = requests.read_events(spark, "/root/testdata/sf0.001")
    requests.append_batches(events, str(tmp_path / "t"))
    requests.append_batches(requests.read_events(spark, "/root/testdata/sf0.001"), str(tmp_path / "t"))
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert spark.read.parquet(str(tmp_path / "t")).count() == n


def workbook(path):
    """A workbook of two sheets with shared, inline and number cells and a gap."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="one" sheetId="1" r:id="r1"/><sheet name="two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>id</t></si><si><t>na</t><t>me</t></si><si><t>900000000000000001</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2" t="inlineStr"><is><t>x</t></is></c></row><row><c r="C3"><v>7</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><sheetData><row><c r="B1"><v>1.5</v></c></row></sheetData></worksheet>')


def test_excel(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    rows = excel.read_excel(spark, str(tmp_path / "w.xlsx"))
    assert rows.columns == ["id", "Unnamed: 1", "name", "name_2"]
    assert [tuple(r) for r in rows.collect()] == [("900000000000000001", None, "x", None), (None, None, "7", None)]
    assert [tuple(r) for r in excel.read_excel(spark, str(tmp_path / "w.xlsx"), "two", header=False).collect()] == [(None, "1.5")]


def test_headers_of_extracts(spark):
    names = ["hco.vid__v (NETWORK ID)", "Corporate Name", "Main Phone", "LOCALITY__V", "address.administrative_area__v (STATE)", "other"]
    df = spark.createDataFrame([("1", "a", "5551234567", "pune", "mh", "z")], ", ".join(f"`{n}` string" for n in names))
    row = schema.logical_organisations(df).first()
    assert (row.vid, row["name"], row.phone, row.city, row.state, row.fax) == ("1", "a", "5551234567", "pune", "mh", None)
    with pytest.raises(ValueError):
        schema.logical_organisations(df.drop("Corporate Name"))
    people = spark.createDataFrame([("7", "rao", "p1", "p2", "e")], "`hcp.vid__v (NETWORK ID)` string, `hcp.last_name__v (LAST NAME)` string, `hcp.phone_1__v (PHONE 1)` string, `hcp.phone_2__v (PHONE 2)` string, `hcp.email_1__v (EMAIL 1)` string")
    row = schema.logical_persons(people).first()
    assert (row.vid, row.last_name, row.phone_1, row.phone_2, row.email_1, row.first_name) == ("7", "rao", "p1", "p2", "e", None)
    assert schema.renamed(spark.createDataFrame([("1",)], "`change_request.owner (OWNER)` string"), schema.REQUEST_COLUMNS).columns == ["owner"]


def test_batch_run(spark, tmp_path):
    rows = ["hco.vid__v (VID),hco.primary_name__v (NAME),hco.hco_type__v (TYPE),hco.city__v (CITY),hco.postal_code__v (POSTAL CODE)"] + [f"{i},Asha Eye Care {i // 2},Clinic,Pune,41100{i // 2}" for i in range(8)]
    (tmp_path / "o.csv").write_text("\n".join(rows))
    done = batch.run_organisations(spark, str(tmp_path / "o.csv"), str(tmp_path / "out"), config())
    assert {"AUTO", "NOT_DUP", "UNIQUE", "CLUSTERS", "SUMMARY", "RULES", "TAGGED"} >= set(done) and {"AUTO", "CLUSTERS", "SUMMARY", "RULES"} <= set(done)
    assert spark.read.csv(str(tmp_path / "out" / "AUTO"), header=True).where("rule = 'H2_NAME_ADDR_TYPE'").count() == 4
    people = ["hcp.vid__v (VID),hcp.first_name__v (FIRST NAME),hcp.last_name__v (LAST NAME),hcp.specialty_1__v (SPECIALTY 1),address.locality__v (CITY),hcp.email_1__v (EMAIL 1)"] + [f"{i},Asha,Rao,{'skin' if i % 2 else 'dermatology'},Pune,a@b.cd" for i in range(2)]
    (tmp_path / "p.csv").write_text("\n".join(people))
    assert "AUTO" in batch.run_persons(spark, str(tmp_path / "p.csv"), str(tmp_path / "out2"), config())
    keys, canon = batch.index_persons(spark, str(tmp_path / "p.csv"), str(tmp_path / "index"), config())
    hits = sinks.probe_index(spark, str(tmp_path / "index"), keys.limit(1))
    assert hits.count() >= 2 and canon.count() == 2


def test_common_names(spark):
    canon = spark.createDataFrame([(str(i), "asha" if i < 5 else f"x{i}", "rao") for i in range(9)], "vid string, first_norm string, last_norm string")
    found = batch.frequent_names(canon, 5)
    assert found == {"first": ["asha"], "last": ["rao"]}
    cfg = config({"common_names": found})
    row = canon.withColumn("said", batch.common_reason(F.col("first_norm"), F.col("last_norm"), cfg)).orderBy("vid").collect()
    assert row[0].said == "'asha' and 'rao' are common Indian names." and row[8].said == "'x8' is uncommon, reducing false-match risk."
