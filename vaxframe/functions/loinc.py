"""LOINC observation identifiers used in immunization messages."""

# Fixed values: (code, label) as published; codes of SUPPRESSED are not shown as stand-alone observations.
LOINC = [
    ("29768-9", "Date Vaccine Information Statement Published"),
    ("29769-7", "Date Vaccine Information Statement Presented"),
    ("30944-3", "Vaccination temporary contraindication/precaution expiration date"),
    ("30945-0", "Vaccination contraindication/precaution"),
    ("30946-8", "Vaccination contraindication/precaution effective date"),
    ("30956-7", "Vaccine Type (Vaccine group or family)"),
    ("30963-3", "Vaccine funding source"),
    ("30973-2", "Dose number in series"),
    ("30979-9", "Vaccines due next"),
    ("30980-7", "Date vaccine due"),
    ("30981-5", "Earliest date to give"),
    ("30982-3", "Reason applied by forecast logic to project this vaccine"),
    ("31044-1", "Reaction"),
    ("38890-0", "Component Vaccine Type"),
    ("46249-9", "VACCINATION TAKE-RESPONSE TYPE"),
    ("46250-7", "VACCINATION TAKE-RESPONSE DATE"),
    ("48767-8", "Annotation comment [Interpretation] Narrative"),
    ("59777-3", "Latest date next dose may be given"),
    ("59778-1", "Date Dose is Overdue"),
    ("59779-9", "Immunization Schedule used"),
    ("59780-7", "Immunization Series name"),
    ("59781-5", "Dose validity"),
    ("59782-3", "Number of doses in primary series"),
    ("59783-1", "Status in immunization series"),
    ("59784-9", "Disease with presumed immunity"),
    ("59785-6", "Indications to immunize"),
    ("64994-7", "Vaccine funding program eligibility category"),
    ("69764-9", "Document type"),
    ("75505-8", "Serological Evidence of Immunity"),
    ("94763-0", "SARS-CoV-2 XXX Ql Cult"),
    ("94661-6", "SARS-CoV-2 Ab SerPl-Imp"),
    ("94762-2", "SARS-CoV-2 Ab SerPl Ql IA"),
    ("94769-7", "SARS-CoV-2 Ab SerPl IA-aCnc"),
    ("94504-8", "SARS-CoV-2 Ab Pnl SerPl IA"),
    ("94558-4", "SARS-CoV-2 Ag Resp Ql IA.rapid"),
    ("94509-7", "SARS-CoV-2 E gene Ct XXX Qn NAA+probe"),
    ("94758-0", "SARS-CoV-2 E gene Resp Ql NAA+probe"),
    ("94765-5", "SARS-CoV-2 E gene SerPl Ql NAA+probe"),
    ("94315-9", "SARS-CoV-2 E gene XXX Ql NAA+probe"),
    ("94562-6", "SARS-CoV-2 IgA SerPl Ql IA"),
    ("94768-9", "SARS-CoV-2 IgA SerPlBld Ql IA.rapid"),
    ("94720-0", "SARS-CoV-2 IgA SerPl IA-aCnc"),
    ("95125-1", "SARS-CoV-2 IgA+IgM SerPl Ql IA"),
    ("94761-4", "SARS-CoV-2 IgG DBS Ql IA"),
    ("94563-4", "SARS-CoV-2 IgG SerPl Ql IA"),
    ("94507-1", "SARS-CoV-2 IgG SerPlBld Ql IA.rapid"),
    ("94505-5", "SARS-CoV-2 IgG SerPl IA-aCnc"),
    ("94503-0", "SARS-CoV-2 IgG+IgM Pnl SerPlBld IA.rapid"),
    ("94547-7", "SARS-CoV-2 IgG+IgM SerPl Ql IA"),
    ("94564-2", "SARS-CoV-2 IgM SerPl Ql IA"),
    ("94508-9", "SARS-CoV-2 IgM SerPlBld Ql IA.rapid"),
    ("94506-3", "SARS-CoV-2 IgM SerPl IA-aCnc"),
    ("94510-5", "SARS-CoV-2 N gene Ct XXX Qn NAA+probe"),
    ("94311-8", "SARS-CoV-2 N gene Ct XXX Qn NAA N1"),
    ("94312-6", "SARS-CoV-2 N gene Ct XXX Qn NAA N2"),
    ("94760-6", "SARS-CoV-2 N gene Nph Ql NAA+probe"),
    ("94533-7", "SARS-CoV-2 N gene Resp Ql NAA+probe"),
    ("94756-4", "SARS-CoV-2 N gene Resp Ql NAA N1"),
    ("94757-2", "SARS-CoV-2 N gene Resp Ql NAA N2"),
    ("94766-3", "SARS-CoV-2 N gene SerPl Ql NAA+probe"),
    ("94316-7", "SARS-CoV-2 N gene XXX Ql NAA+probe"),
    ("94307-6", "SARS-CoV-2 N gene XXX Ql NAA N1"),
    ("94308-4", "SARS-CoV-2 N gene XXX Ql NAA N2"),
    ("94644-2", "SARS-CoV-2 ORF1ab Ct Resp Qn NAA+probe"),
    ("94511-3", "SARS-CoV-2 ORF1ab Ct XXX Qn NAA+probe"),
    ("94559-2", "SARS-CoV-2 ORF1ab Resp Ql NAA+probe"),
    ("94639-2", "SARS-CoV-2 ORF1ab XXX Ql NAA+probe"),
    ("94646-7", "SARS-CoV-2 RdRp Ct Resp Qn NAA+probe"),
    ("94645-9", "SARS-CoV-2 RdRp Ct XXX Qn NAA+probe"),
    ("94534-5", "SARS-CoV-2 RdRp Resp Ql NAA+probe"),
    ("94314-2", "SARS-CoV-2 RdRp XXX Ql NAA+probe"),
    ("94745-7", "SARS-CoV-2 RNA Ct Resp Qn NAA+probe"),
    ("94746-5", "SARS-CoV-2 RNA Ct XXX Qn NAA+probe"),
    ("94819-0", "SARS-CoV-2 RNA XXX NAA+probe-Log#"),
    ("94565-9", "SARS-CoV-2 RNA Nph Ql NAA+non-probe"),
    ("94759-8", "SARS-CoV-2 RNA Nph Ql NAA+probe"),
    ("94500-6", "SARS-CoV-2 RNA Resp Ql NAA+probe"),
    ("94845-5", "SARS-CoV-2 RNA Sal Ql NAA+probe"),
    ("94822-4", "SARS-CoV-2 RNA Sal Ql Seq"),
    ("94660-8", "SARS-CoV-2 RNA SerPl Ql NAA+probe"),
    ("94309-2", "SARS-CoV-2 RNA XXX Ql NAA+probe"),
    ("94531-1", "SARS-CoV-2 RNA Pnl Resp NAA+probe"),
    ("94306-8", "SARS-CoV-2 RNA Pnl XXX NAA+probe"),
    ("94642-6", "SARS-CoV-2 S gene Ct Resp Qn NAA+probe"),
    ("94643-4", "SARS-CoV-2 S gene Ct XXX Qn NAA+probe"),
    ("94640-0", "SARS-CoV-2 S gene Resp Ql NAA+probe"),
    ("94767-1", "SARS-CoV-2 S gene SerPl Ql NAA+probe"),
    ("94641-8", "SARS-CoV-2 S gene XXX Ql NAA+probe"),
    ("94764-8", "SARS-CoV-2 genome Islt-Seq"),
    ("95209-3", "SARS-CoV+SARS-CoV-2 Ag Resp Ql IA.rapid"),
    ("94313-4", "SARS-like CoV N Ct XXX Qn NAA+probe"),
    ("94310-0", "SARS-like CoV N XXX Ql NAA+probe"),
    ("94502-2", "SARS-rel CoV RNA Resp Ql NAA+probe"),
    ("94647-5", "SARSr-CoV RNA XXX Ql NAA+probe"),
    ("94532-9", "SARS-rel CoV+MERS RNA Resp Ql NAA+probe"),
    ("TPG_PAND", "Priority Group - Pandemic"),
    ("TPG_POP_GRP", "Priority Group - Population Group"),
    ("TPG_TIER", "Priority Group - Tier"),
]

SUPPRESSED = [
    "29768-9",
    "29769-7",
    "30956-7",
    "30963-3",
    "30973-2",
    "30979-9",
    "30980-7",
    "30981-5",
    "30982-3",
    "38890-0",
    "59777-3",
    "59778-1",
    "59779-9",
    "59780-7",
    "59781-5",
    "59782-3",
    "59783-1",
    "64994-7",
    "69764-9",
]

PRIORITY_GROUPS = ["TPG_PAND", "TPG_POP_GRP", "TPG_TIER"]
