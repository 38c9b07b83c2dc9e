"""Binding of physical headers to logical columns, on the driver, before any plan is made."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(headers: list[str], wanted: dict[str, list[str]], keywords: dict[str, list[list[str]]] | None = None) -> dict[str, str]:
    """Logical name to header: the exact alias, then the alias in any case, then a header that holds all keywords of a set.

    Each header is bound once, in the order of ``wanted``.
    """
    free, out = list(headers), {}
    for step in ("exact", "case", "keyword"):
        for name, aliases in wanted.items():
            if name in out:
                continue
            if step == "exact":
                hit = next((a for a in aliases if a in free), None)
            elif step == "case":
                lower = [a.lower() for a in aliases]
                hit = next((h for h in free if h.lower() in lower), None)
            else:
                hit = next((h for words in (keywords or {}).get(name, []) for h in free if all(w in h.lower() for w in words)), None)
            if hit:
                out[name] = hit
                free.remove(hit)
    return out


# Headers of extracts.
ORG_ALIASES: dict[str, list[str]] = {
    "vid": ["hco.vid__v (VID)", "hco.vid__v (NETWORK ID)", "hco.vid__v"],
    "name": ["hco.primary_name__v (NAME)", "hco.corporate_name__v (CORPORATE NAME)", "hco.corporate_name__v (CORPORATE_NAME)", "corporate_name__v)", "corporate_name__v", "Corporate Name"],
    "type": ["hco.hco_type__v (TYPE)", "hco.hco_type__v (HCO TYPE)", "hco.hco_type__v (HCO_TYPE)", "hco_type__v", "HCO Type"],
    "phone": ["hco.phone__v (PHONE)", "address.phone_1__v (PHONE 1)", "address.phone_1__v (PHONE)", "phone_1__v (1 )", "phone_1__v (1)", "phone_1__v", "Phone 1", "Phone"],
    "fax": ["hco.fax__v (FAX)", "address.fax_1__v (FAX 1)", "address.fax_1__v (FAX)", "fax_1__v (1 )", "fax_1__v (1)", "fax_1__v", "Fax 1", "Fax"],
    "city": ["hco.city__v (CITY)", "address.locality__v (CITY)", "locality__v", "City"],
    "state": ["hco.state__v (STATE)", "address.administrative_area__v (STATE/PROVINCE)", "address.administrative_area__v (STATE)", "administrative_area__v", "State/Province", "State"],
    "postal": ["hco.postal_code__v (POSTAL CODE)", "address.postal_code__v (ZIP/POSTAL CODE)", "address.postal_code__v (POSTAL CODE)", "address.postal_code__v (ZIP)", "postal_code__v", "ZIP/Postal Code", "Postal Code", "ZIP Code"],
    "address_1": ["hco.address_line_1__v (ADDRESS LINE 1)", "address.address_line_1__v (ADDRESS LINE 1)", "address_line_1__v", "Address Line 1"],
    "address_2": ["hco.address_line_2__v (ADDRESS LINE 2)", "address.address_line_2__v (ADDRESS LINE 2)", "address_line_2__v", "Address Line 2"],
    "status": ["hco.hco_status__v (STATUS)", "hco_status__v", "Status"],
}
ORG_KEYWORDS: dict[str, list[list[str]]] = {
    "name": [["corporate", "name"], ["primary", "name"], ["hco", "name"]], "type": [["hco", "type"]], "phone": [["phone"]], "fax": [["fax"]], "city": [["city"], ["locality"]], "state": [["state"], ["province"]],
    "postal": [["postal"], ["zip"]], "address_1": [["address", "line", "1"], ["address", "line"]], "address_2": [["address", "line", "2"]], "status": [["status"]],
}
REQUEST_COLUMNS = {
    "hcp.vid__v (VID)": "vid", "hcp.first_name__v (FIRST NAME)": "first_name", "hcp.last_name__v (LAST NAME)": "last_name", "hcp.hcp_type__v (HCP TYPE)": "hcp_type", "change_request.change_request_id (CHANGE REQUEST ID)": "change_request_id",
    "change_request.source (SOURCE)": "source", "change_request_hcp.custom_comments__c_req (STEWARD NOTE (REQUESTED))": "steward_note", "change_request_hco.corporate_name__v_req (CORPORATE NAME (REQUESTED))": "corporate_name",
    "change_request.change_request_type (TYPE)": "type", "change_request.owner (OWNER)": "owner", "change_request.state_key (STATE KEY)": "state_key",
}
NETWORK_COLUMNS = {
    "hcp.vid__v (VID)": "vid", "hcp.first_name__v (FIRST NAME)": "first_name", "hcp.last_name__v (LAST NAME)": "last_name", "hcp.primary_country__v (PRIMARY COUNTRY)": "country", "hcp.specialty_1__v (SPECIALTY 1)": "specialty_1",
    "hcp.specialty_2__v (SPECIALTY 2)": "specialty_2", "hcp.hcp_status__v (STATUS)": "status", "hcp.source_full_name__v (SOURCE FULL NAME)": "source_full_name", "hcp.city_cda__v (CITY (CDA))": "city", "hcp.custom_degree_1__c (CUSTOM DEGREE 1)": "degree_1",
    "hcp.custom_degree_2__c (CUSTOM DEGREE 2)": "degree_2", "hcp.hcp_type__v (HCP TYPE)": "hcp_type", "hcp.gender__v (GENDER)": "gender", "hco.parent_hco_vid__v (PARENT_HCO_VID__V)": "parent_hco_vid", "hco.parent_hco_name__v (PARENT_HCO_NAME__V)": "parent_hco_name",
    "address.locality__v (CITY)": "address_city", "address.administrative_area__v (STATE/PROVINCE)": "state", "hcp.custom_comments__c (STEWARD NOTE)": "steward_note_nwk",
}
PERSON_COLUMNS: dict[str, list[str]] = {
    "vid": ["hcp.vid__v (VID)"], "last_name": ["hcp.last_name__v (LAST NAME)"], "first_name": ["hcp.first_name__v (FIRST NAME)"], "middle_name": ["hcp.middle_name__v (MIDDLE NAME)"], "full_name": ["hcp.source_full_name__v (SOURCE FULL NAME)"],
    **{f"specialty_{i}": [f"hcp.specialty_{i}__v (SPECIALTY {i})"] for i in range(1, 5)},
    "license_number": ["license.license_number__v (LICENSE)"], "license_body": ["license.licensing_body__v (LICENSING BODY)"], "license_status": ["license.license_status__v (LICENSE STATUS)"], "hco_vid": ["hco.hco_vid__v (HCO_VID__V)"],
    "city_cda": ["hcp.city_cda__v (CITY (CDA))"], "city": ["address.locality__v (CITY)"], "state": ["address.administrative_area__v (STATE/PROVINCE)"], "postal": ["address.postal_code__v (ZIP/POSTAL CODE)"], "status": ["hcp.hcp_status__v (STATUS)"], "candidate": ["hcp.candidate_record__v (CANDIDATE RECORD)"],
}
IDS = ["hcp.vid__v (VID)", "hco.vid__v (VID)"]


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Known headers under their short names; other columns stay."""
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def with_id_headers(df: DataFrame) -> DataFrame:
    """An id column that is the only one with its header's beginning takes the usual header."""
    for header in IDS:
        begin = header.split(" ")[0]
        hits = [c for c in df.columns if c.lower().startswith(begin)]
        if header not in df.columns and len(hits) == 1:
            df = renamed(df, {hits[0]: header})
    return df


def logical_organisations(df: DataFrame) -> DataFrame:
    """An organisation extract under logical names, missing columns as nulls.  Id and name must be there."""
    df = with_id_headers(df)
    bound = resolve(df.columns, ORG_ALIASES, ORG_KEYWORDS)
    lacking = [n for n in ("vid", "name") if n not in bound]
    if lacking:
        raise ValueError(f"no column for {lacking} among {df.columns}")
    return select_logical(df, bound, list(ORG_ALIASES))


def logical_persons(df: DataFrame) -> DataFrame:
    """A person extract under logical names, with every phone and e-mail column.  Id and last name must be there."""
    df = with_id_headers(df)
    bound = resolve(df.columns, PERSON_COLUMNS)
    lacking = [n for n in ("vid", "last_name") if n not in bound]
    if lacking:
        raise ValueError(f"no column for {lacking} among {df.columns}")
    for kind in ("phone", "email"):
        bound |= {f"{kind}_{i + 1}": c for i, c in enumerate(by_prefix(df, f"hcp.{kind}_"))}
    return select_logical(df, bound, [*PERSON_COLUMNS, *sorted(set(bound) - set(PERSON_COLUMNS))])


#: Rules for the columns of external lists, most telling first: fixed patterns.
EXTERNAL = [
    ("vid", r"^(vid|.*\bnetwork id\b.*|.*vid__v.*)$"), ("link_id", r"^(link ?id|external ?id|source ?id)$"), ("first_name", r"^(first|given)[ _]?name.*$"), ("middle_name", r"^middle[ _]?name.*$"),
    ("last_name", r"^(last|family|sur)[ _]?name.*$"), ("full_name", r"^((full|doctor|hcp|provider)[ _]?name|name)$"), ("specialty", r".*special(i)?ty.*"), ("email", r".*e-?mail.*"), ("phone", r".*(phone|mobile|contact no).*"),
    ("city", r".*(city|locality|town).*"), ("state", r".*(state|province|region).*"), ("postal", r".*(postal|pin ?code|zip|pincode).*"), ("country", r".*country.*"), ("affiliation", r".*(affiliation|hospital|organi[sz]ation|institution|clinic).*"), ("credentials", r".*(credential|degree|qualification).*"),
]
MANY = {"specialty", "email", "phone"}


def detect(headers: list[str]) -> dict[str, list[str]]:
    """Logical name to headers of an external list; each header is claimed once, some names take several."""
    free, out = list(headers), {}
    for name, pattern in EXTERNAL:
        hits = [h for h in free if re.match(pattern, h.strip().lower())]
        if hits:
            out[name] = hits if name in MANY else hits[:1]
            free = [h for h in free if h not in out[name]]
    return out


def missing_signals(found: dict[str, list[str]]) -> list[str]:
    """Which signals cannot fire for want of columns."""
    needs = {"name": ("last_name", "full_name"), "specialty": ("specialty",), "contact": ("phone", "email"), "place": ("city", "state", "postal"), "affiliation": ("affiliation",)}
    return [signal for signal, columns in needs.items() if not any(c in found for c in columns)]


def select_logical(df: DataFrame, bound: dict[str, str], logical: list[str]) -> DataFrame:
    """Logical columns as text; those without a header are null, so that plans stay the same."""
    return df.select(*[(F.col(f"`{bound[n]}`").cast("string") if n in bound else F.lit(None).cast("string")).alias(n) for n in logical])


def by_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]
