"""One firing and one silent message per rule, flavors on and off."""

import datetime as dt

import pytest

from vaxframe.functions import codes as C
from vaxframe.functions.rule_texts import TEXTS
from vaxframe.operators import acceptance, hl7, rulebook, rules

GOOD = "\r".join([
    "MSH|^~\\&|EHR|ORG|REG|IIS|20200101||VXU^V04|C1|P|2.5.1|||||||||Z22^CDCPHINVS",
    "PID|1||M1^^^AUTH^MR||Last^First^Mid^^^^L|Maiden|20000101|F||2106-3^W^CDCREC|1 Main St^^Town^MI^49000^USA^P||^PRN^PH^^^269^5713805"
    "|||||||||2186-5^N^CDCREC||N|1||||",
    "PD1|||||||||||02|N|20010101|||A|20010101|20010101",
    "NK1|1|Guard^Ian^Q^^^^L|MTH^Mother^HL70063",
    "ORC|RE||V1^ORG",
    "RXA|0|1|20100101||03^MMR^CVX|0.5|mL||00^New^NIP001|PRV^Doc^A|^^^FAC1||||LOT|20301231|MSD^M^MVX|||CP|A",
    "RXR|C28161^IM^NCIT|LA^L^HL70163",
    "OBX|1|CE|64994-7^E^LN|1|V05^V^HL70064||||||F|||20100101",
])
ORU = GOOD.replace("VXU^V04", "ORU^R01").replace("RXA|0|1|20100101||03^MMR^CVX|0.5|mL||00^New^NIP001|PRV^Doc^A|^^^FAC1||||LOT|20301231|MSD^M^MVX|||CP|A", "OBR|1")

# rule, severity, (old, new) edits, flavors
FIRES = [
    ("V01", "E", [("|ORG|REG", "|OTHER|REG")], ["SOURSOP"]),
    ("V02", "E", [("VXU^V04", "ADT^A04")], []),
    ("V59", "E", [("MSH|", "ZZZ|")], []),
    ("V64", "E", [("PID|1", "MSH|^~\\&|X\rPID|1")], []),
    ("V08", "E", [("03^MMR^CVX", "^MMR^CVX")], []),
    ("V09", "E", [("V1^ORG", "^ORG")], []),
    ("V10", "E", [("|20100101||03", "|20100230||03")], []),
    ("V10", "E", [("|20100101||03", "|||03")], []),
    ("V11", "E", [("|20100101||03", "|20991231||03")], []),
    ("V12", "W", [("03^MMR^CVX", "03^MMR^CVX^N0^X^NDC")], []),
    ("V13", "W", [("03^MMR^CVX", "08^HEPB^CVX^N1^X^NDC")], []),
    ("V14", "W", [("03^MMR^CVX", "03^MMR^CVX^P0^X^CPT")], []),
    ("V15", "W", [("03^MMR^CVX", "08^HEPB^CVX^P1^X^C4")], []),
    ("V16", "E", [("03^MMR^CVX", "N0^X^NDC")], []),
    ("V17", "E", [("03^MMR^CVX", "777^X^CVX")], []),
    ("V18", "E", [("^^^FAC1", "^^^FAC9")], ["PEAR"]),
    ("V19", "W", [("|20301231|", "|20301331|")], []),
    ("V20", "W", [("MSD^M^MVX||", "MSD^M^MVX|QQ|")], []),
    ("V21", "E", [("RXR|C28161^IM^NCIT|LA^L^HL70163\r", "")], ["SPRUCE"]),
    ("V22", "E", [("|20100101||03", "|19991231||03")], []),
    ("V23", "W", [("|V05^V", "|V99^V")], []),
    ("V24", "W", [("64994-7^E^LN|1|V05", "30963-3^E^LN|1|QQ")], []),
    ("V25", "E", [("RXA|", "ZZZ|")], []),
    ("V26", "E", [("|CP|A", "|RE|A")], ["CRANBERRY"]),
    ("V27", "E", [("|CP|A", "|NA|A")], ["BILBERRY"]),
    ("V28", "E", [("^MR||Last", "^ZZ||Last")], []),
    ("V29", "E", [("PID|1", "ZZZ|1")], []),
    ("V30", "W", [("^PRN^PH", "^ORN^PH")], []),
    ("V30", "E", [("^PRN^PH", "^ORN^PH")], ["QUINZE"]),
    ("V31", "W", [("^269^5713805", "^269^57x13805")], []),
    ("V32", "W", [("^269^5713805", "^555^5713805")], []),
    ("V32", "W", [("^269^5713805", "^^")], []),
    ("V33", "E", [("Last^First", "^First")], []),
    ("V34", "E", [("Last^First", "Last^")], []),
    ("V35", "E", [("|20000101|F", "|20000230|F")], []),
    ("V35", "E", [("|20000101|F", "||F")], []),
    ("V36", "E", [("|20000101|F", "|20991231|F")], []),
    ("V37", "W", [("||N|1||||", "||N|1||||20000230")], []),
    ("V38", "W", [("20000101|F|", "20000101|Q|")], ["ELDERBERRIES"]),
    ("V39", "E", [("^USA^P", "^ZZZ^P")], []),
    ("V39", "W", [("^USA^P", "^ZZZ^P")], ["GUAVA"]),
    ("V40", "E", [("^MI^", "^QQ^")], []),
    ("V40", "W", [("^MI^", "^QQ^")], ["GUAVA"]),
    ("V41", "W", [("2106-3", "OLD-1")], []),
    ("V41", "E", [("2106-3", "9999-9")], ["FIG"]),
    ("V42", "W", [("2186-5", "BAD")], []),
    ("V42", "E", [("2186-5", "BAD")], ["FIG"]),
    ("V43", "E", [("1 Main St", "")], ["BLACKBERRY"]),
    ("V44", "E", [("||N|1|", "||N|2|")], []),
    ("V44", "W", [("||N|1|", "|||2|")], ["PLANTAIN"]),
    ("V45", "W", [("||N|1|", "||Y||")], []),
    ("V46", "E", [("||N|1|", "||Y|12|")], []),
    ("V47", "E", [("||N|1|", "||Z|1|")], []),
    ("V48a", "W", [("|N|20010101|", "|N|20010230|")], []),
    ("V48b", "W", [("|A|20010101|", "|A|2001|")], []),
    ("V48c", "W", [("|A|20010101|20010101", "|A|20010101|BAD")], []),
    ("V49", "W", [("Guard^Ian", "^Ian")], []),
    ("V50", "W", [("Guard^Ian", "Guard^")], []),
    ("V51", "W", [("MTH^Mother", "^")], []),
    ("V52", "W", [("MTH^Mother", "SIB^Sibling")], []),
    ("V54", "W", [("64994-7^E^LN|1|V05", "30945-0^E^LN|1|QQ")], []),
    ("V55", "W", [("64994-7^E^LN|1|V05", "30945-0^E^LN|1|VXC18"), ("F|||20100101", "F|||20991231")], []),
    ("V56", "W", [("64994-7^E^LN|1|V05", "30945-0^E^LN|1|VXC18"), ("F|||20100101", "F|||19990101")], []),
    ("V57", "W", [("F|||20100101", "F|||2010")], []),
]
SILENT = [
    ("V01", [("|ORG|REG", "|OTHER|REG")], []),
    ("V10", [("|20100101||03", "|20100230||03")], ["CANTALOUPE"]),
    ("V18", [("^^^FAC1", "^^^FAC9")], []),
    ("V21", [("RXR|C28161^IM^NCIT|LA^L^HL70163\r", "")], []),
    ("V22", [("|20100101||03", "|19991231||03")], ["CLEMENTINE"]),
    ("V26", [("|CP|A", "|RE|A")], []),
    ("V27", [("|CP|A", "|RE|A")], ["BILBERRY"]),
    ("V09", [("V1^ORG", "^ORG"), ("03^MMR^CVX", "998^None^CVX")], []),
    ("V12", [("03^MMR^CVX", "03^MMR^CVX^UNKNOWN^X^NDC")], []),
    ("V43", [("1 Main St", "")], []),
    ("V28", [("^MR||Last", "^PI||Last")], []),
    ("V52", [("NK1|1|Guard", "NK1|1|A^B|SIB\rNK1|1|Guard")], ["NONE"]),
]


def edit(text, edits):
    for old, new in edits:
        assert old in text, old
        text = text.replace(old, new, 1)
    return text


@pytest.fixture(scope="module")
def outcome(spark):
    cases = [(edit(GOOD, e), f) for _, _, e, f in FIRES] + [(edit(GOOD, e), f) for _, e, f in SILENT]
    cases += [(GOOD, []), (ORU, []), (ORU.replace("OBR|1", "ZZZ|1"), []), (GOOD.replace("\r", "\r\n"), []), (GOOD.replace("\r", "\n"), [])]
    day = dt.date(2020, 1, 1)
    messages = spark.createDataFrame([(i, i, day, m) for i, (m, _) in enumerate(cases)], "msg_id long, org_id int, received_date date, message string")
    orgs = spark.createDataFrame([(i, "ORG", f) for i, (_, f) in enumerate(cases)], "org_id int, org_name string, flavors array<string>")
    codes = C.seed_codes(spark).unionByName(spark.createDataFrame(
        [("VACCINATION_NDC_CODE", "N0", "n0", "VALID", None), ("VACCINATION_NDC_CODE", "N1", "n1", "VALID", None),
         ("VACCINATION_CPT_CODE", "P0", "p0", "VALID", None), ("VACCINATION_CPT_CODE", "P1", "p1", "VALID", None)],
        "codeset string, value string, label string, status string, new_value string"))
    relations = spark.createDataFrame([("VACCINATION_NDC_CODE", "N1", "03"), ("VACCINATION_CPT_CODE", "P1", "03")],
                                      "from_set string, from_value string, to_cvx string")
    locations = spark.createDataFrame([(i, "FAC1") for i in range(len(cases))], "org_id int, facility_code string")
    v = rules.Validation(messages, orgs, codes, relations, C.seed_valid_values(spark), "date '2020-06-01'", locations)
    report = {r.msg_id: r for r in v.report.collect()}
    acks = {r.msg_id: r.ack for r in acceptance.build_ack(v.report).collect()}
    return report, acks


@pytest.mark.parametrize("i", range(len(FIRES)), ids=[f"{r}-{s}-{'-'.join(f)}-{i}" for i, (r, s, _, f) in enumerate(FIRES)])
def test_rule_fires(outcome, i):
    rule, severity, _, _ = FIRES[i]
    hits = [f for f in outcome[0][i].findings if f.rule == rule]
    assert [f.severity for f in hits] == [severity]
    assert any(hits[0].text.startswith(t.split("{}")[0]) for r, t in TEXTS.items() if r.startswith(rule))
    assert ("MSA|AE|" in outcome[1][i]) and hits[0].text in outcome[1][i]


@pytest.mark.parametrize("i", range(len(SILENT)), ids=[f"{r}-{'-'.join(f)}-{i}" for i, (r, _, f) in enumerate(SILENT)])
def test_rule_stays_silent(outcome, i):
    rule, _, flavors = SILENT[i]
    hits = [f.rule for f in outcome[0][len(FIRES) + i].findings]
    assert (rule in hits) == (flavors == ["NONE"])


def test_good_messages_pass(outcome):
    base = len(FIRES) + len(SILENT)
    for n in (base, base + 1, base + 3, base + 4):
        assert outcome[0][n].findings == []
    assert "MSA|AA|C1" in outcome[1][base]
    assert outcome[0][base].vaccinations == 1
    assert [f.rule for f in outcome[0][base + 2].findings] == ["V53"]


def test_thrown_error_stops_the_message(outcome):
    i = next(n for n, c in enumerate(FIRES) if c[0] == "V33")
    assert [f.rule for f in outcome[0][i].findings][-1] == "V33"


def test_segments_join_back_to_the_message(spark):
    rows = spark.createDataFrame([(1, GOOD)], "msg_id long, message string")
    lines = [r.line for r in hl7.segments(rows).orderBy("pos").collect()]
    assert "\r".join(lines) == GOOD


def test_masks_and_findings_agree(outcome):
    for row in outcome[0].values():
        errors = sum(bin(e.errors).count("1") for e in row.entries)
        assert errors == sum(f.severity == "E" for f in row.findings)
        assert sum(bin(e.mask).count("1") for e in row.entries) == len(row.findings)
        assert all(e.errors & ~e.mask == 0 and e.mask for e in row.entries)


@pytest.mark.parametrize(("rule", "text"), [
    ("V15", "CPT P1 maps to 03 but CVX 08 was also reported, preferring CVX code"),
    ("V12", "Unrecognized NDC N0"),
    ("V23", "Funding eligibility 'V99' was not recognized"),
    ("V10", "Could not read administered date in RXA-5: Unparseable date: \"20100230\""),
])
def test_values_are_put_into_the_wording(outcome, rule, text):
    i = next(n for n, c in enumerate(FIRES) if c[0] == rule)
    assert [f.text for f in outcome[0][i].findings if f.rule == rule] == [text]


def test_a_cut_mask_ends_with_the_first_thrown_bit(spark):
    group = rulebook.Group(1, *[rulebook.finding("V02", "true", "E", "", 0, thrown=i in (2, 4)) for i in range(6)])
    got = spark.sql(f"select id, {group.cut('id')} as kept from range(64)").collect()
    for r in got:
        fired = [i for i in range(6) if r.id >> i & 1]
        stop = next((i for i in fired if i in (2, 4)), 6)
        assert r.kept == sum(1 << i for i in fired if i <= stop)
