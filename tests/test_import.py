"""Folders of contact files with unlike headers and encodings."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from rosterlake.plans.importer import plan_import
from rosterlake.plans.phones import merge_phone_files
from rosterlake.sources.tables import header_fields, read_contact_files, read_roster


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, data in files.items():
        (folder / f"{name}.csv").write_bytes(data)
    return f"{folder}/*.csv"


@pytest.fixture
def folder(tmp_path):
    return write(
        tmp_path / "in",
        a="College,City,Contact Email\r\nÉcole Ü,Mysuru,one@a.org\r\n\r\n\"Quoted, \"\"name\"\"\",Udupi,two@a.org\r\n".encode(),
        b="﻿pos,State,Name of the Institution\n9,Kerala,Byte order\n8,Goa,Second row\n".encode(),
        c="Institute Name,State\nCaf\xe9 \xdcber,Kerala\n\"two\nlines\",Goa\n".encode("latin-1"),
        d=b"State,Name,Remarks,State\nKerala,short row\nGoa,Long,x,y,z,more\n",
        e=b"",
    )


@pytest.mark.parametrize("multiline", [True, False])
def test_each_file_keeps_its_own_header(spark, folder, multiline):
    found = read_contact_files(spark, folder, multiline=multiline)
    rows = found.mapped(("college_name", "state", "district", "placement_email")).orderBy("pos").collect()
    got = [tuple(r)[1:] for r in rows]
    two = [("two\nlines", "Goa", None, None)] if multiline else [("two", None, None, None), ('lines"', "Goa", None, None)]
    lines = [g for g in got if "two" in g[0] and "@" not in str(g) or "lines" in g[0]]
    assert len(lines) == len(two)
    if multiline:
        assert got == [
            ("École Ü", None, "Mysuru", "one@a.org"), ('Quoted, "name"', None, "Udupi", "two@a.org"),
            ("Byte order", "Kerala", None, None), ("Second row", "Goa", None, None),
            ("Café Über", "Kerala", None, None), *two, ("short row", "Kerala", None, None), ("Long", "Goa", None, None),
        ]
    kinds = {r.file.rsplit("/", 1)[1]: (r.utf8, r.headers, r.fields) for r in found.files.collect()}
    assert kinds["a.csv"] == (True, ["College", "City", "Contact Email"], ["college_name", "district", "placement_email"])
    assert kinds["b.csv"] == (True, ["pos", "State", "Name of the Institution"], [None, "state", "college_name"])
    assert kinds["c.csv"][0] is False and kinds["d.csv"][2] == ["state", "college_name", None, None]


def test_a_file_without_names_rejects_its_rows_only(spark, tmp_path):
    path = write(tmp_path / "in", a=b"College,State\nLakeview College,Kerala\n", b=b"State,Remarks\nKerala,x\n")
    plan = plan_import(read_contact_files(spark, path))
    assert Counter(r.reject for r in plan.rows.collect()) == {None: 1, "no_name": 1}
    assert [(r.file[-5:], r.header) for r in plan.unmapped.collect()] == [("b.csv", "Remarks")]
    with pytest.raises(ValueError):
        read_contact_files(spark, write(tmp_path / "none", a=b"State,Remarks\nKerala,x\n")).mapped(("college_name",))


def test_the_first_filled_cell_of_a_key_wins_in_the_order_of_the_file(spark, tmp_path):
    rows = "".join(f"Lakeview College,Kerala,{'' if i < 3 else f'c{i}@a.org'}\n" for i in range(40))
    plan = plan_import(read_contact_files(spark, write(tmp_path / "in", a=f"College,State,Email\n{rows}".encode())))
    assert [(r.placement_email, r.copies) for r in plan.records.collect()] == [("c3@a.org", 40)]


def test_an_empty_folder_of_headers(spark, tmp_path):
    path = write(tmp_path / "in", a=b"College,State\n", b=b"College,State")
    plan = plan_import(read_contact_files(spark, path))
    assert plan.rows.count() == 0 and plan.records.count() == 0 and plan.files.count() == 2


@pytest.mark.parametrize("headers, fields", [
    (["Name of the College", "State", "City", "Affiliated To", "Web URL", "Contact Person", "Email ID", "Mobile No", "Course", "Remarks"],
     ["college_name", "state", "district", "affiliation", "website", "placement_officer_name", "placement_email", "placement_phone", "stream", None]),
    (["College", "State", "Placement Email"], ["college_name", "state", "placement_email"]),
    (["Email", "Email ID", "Phone (office)", "Phone"], ["placement_email", None, None, "placement_phone"]),
    (["College Name (full)", "All Emails Found", "", "!!"], ["college_name", "fallback_contact_email", None, None]),
    ([], []),
])
def test_headers_and_their_fields(spark, headers, fields):
    frame = spark.createDataFrame([(headers,)], "headers array<string>")
    assert frame.select(header_fields(F.col("headers")).alias("f")).first()["f"] == fields


def test_phone_rosters_merge_into_the_columns_of_the_organisations(spark, tmp_path):
    orgs = write(tmp_path / "orgs", a="College,State,pos,all_phones_found\nLakeview College,Kerala,7,old\nHilltop College,Goa,8,\n".encode())
    contacts = write(tmp_path / "contacts", a=b"Name,State,Mobile\nLAKEVIEW COLLEGE,kerala,9876543210\n", b=b"Phones,Institution,State\n98450 12345,Lakeview College,Kerala\n")
    merge_phone_files(spark, orgs, contacts, f"{tmp_path}/out")
    got = spark.read.csv(f"{tmp_path}/out", header=True)
    assert got.columns == ["College", "State", "pos", "all_phones_found"]
    assert [(r.College, r.pos, r.all_phones_found) for r in got.orderBy("pos").collect()] == [
        ("Lakeview College", "7", "+91-9876543210, +91-9845012345"), ("Hilltop College", "8", None),
    ]
    with pytest.raises(ValueError):
        read_roster(spark, write(tmp_path / "x", a=b"Name,State\nA,B\n"), with_phones=True)
