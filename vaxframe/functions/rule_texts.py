"""Texts of the validation findings.

Fixed values: the wording a sender sees in ERR-8; ``{}`` marks inserted values.
"""

TEXTS = {
    "V01": "Internal error prevented processing: Not allowed to submit for facility indicated in MSH-4",
    "V02": "Unsupported message",
    "V03": "QPD segment not found",
    "V04": "Last name is missing",
    "V05": "First name is missing",
    "V06": "Date of Birth is missing",
    "V07": "Invalid patient birth date: Unparseable date: \"{}\"",
    "V08": "Vaccine code is not indicated in RXA-5.1",
    "V09": "Vaccination order id was not found, unable to process",
    "V10": "Could not read administered date in RXA-5: {}",
    "V11": "Vaccination is indicated as occuring in the future, unable to accept future vaccination events",
    "V12": "Unrecognized NDC {}",
    "V13": "NDC {} maps to {} but CVX {} was also reported, preferring CVX code",
    "V14": "Unrecognized CPT {}",
    "V15": "CPT {} maps to {} but CVX {} was also reported, preferring CVX code",
    "V16": "Unable to find a recognized vaccine administration code (CVX, NDC, or CPT)",
    "V17": "Unrecognized CVX vaccine '{}'",
    "V18": "Unrecognized administered at location, unable to accept immunization report",
    "V19": "Invalid vaccination expiration date: Unparseable date: \"{}\"",
    "V20": "Unrecognized refusal reason",
    "V21": "RXR segment is required for administered vaccinations",
    "V22": "Vaccination is reported as having been administered before the patient was born",
    "V23": "Funding eligibility '{}' was not recognized",
    "V24": "Funding source '{}' was not recognized",
    "V25": "RXA segment was not found after ORC segment",
    "V26": "Patient vaccination history cannot be accepted without at least one administered or historical vaccination specified",
    "V27": "Patient vaccination history cannot be accepted without at least one administered, historical, or refused vaccination specified",
    "V28": "MRN was not found, required for accepting vaccination report",
    "V29": "No PID segment found, required for accepting vaccination report",
    "V30": "Patient phone telecommunication type must be PRN ",
    "V31": "Patient phone number has unexpected character: {}",
    "V32": "Patient phone number does not appear to be valid",
    "V33": "Patient last name was not found, required for accepting patient and vaccination history",
    "V34": "Patient first name was not found, required for accepting patient and vaccination history",
    "V35": "Bad format for date of birth: {}",
    "V36": "Patient is indicated as being born in the future, unable to record patients who are not yet born",
    "V37": "Invalid patient death date: Unparseable date: \"{}\"",
    "V38": "Patient sex '{}' is not recognized",
    "V39": "Patient address country '{}' is not recognized and cannot be accepted",
    "V40": "Patient address state '{}' is not recognized and cannot be accepted",
    "V41": "Invalid race '{}', message cannot be accepted",
    "V42": "Invalid ethnicity '{}', message cannot be accepted",
    "V43": "Patient address is required but it was not sent",
    "V44": "Birth order was specified as {} but not indicated as multiple birth",
    "V45": "Multiple birth but birth order was not specified",
    "V46": "Birth order was specified as {} but not an expected value, must be between 1 and 9",
    "V47": "Multiple birth indicator {} is not recognized",
    "V48a": "Invalid protection indicator date: Unparseable date: \"{}\"",
    "V48b": "Invalid registry status indicator date: Unparseable date: \"{}\"",
    "V48c": "Invalid publicity indicator date: Unparseable date: \"{}\"",
    "V49": "Next-of-kin last name is empty",
    "V50": "Next-of-kin first name is empty",
    "V51": "Next-of-kin relationship is empty",
    "V52": "Next-of-kin relationship not specified so is not recognized as guardian and will be ignored",
    "V52b": "Next-of-kin relationship '{}' is not a recognized guardian and will be ignored",
    "V53": "OBR segment was not found after ORC segment",
    "V54": "Unrecognized contraindication or precaution",
    "V55": "Contraindication or precaution observed in the future",
    "V56": "Contraindication or precaution observed before patient was born",
    "V57": "Unparsable date/time of observation: Unparseable date: \"{}\"",
    "V58": "Unrecognized profile id '{}'",
    "V59": "Internal error prevented processing: MSH segment not found",
    "V60": "Immunization identifier must be specified",
    "V61": "Patient reference was not found",
    "V62": "Patient external link must be indicated",
    "V63": "Vaccination is reported as having been administered before the patient was born",
    "V64": "Only one message may be submitted at a time",
}
