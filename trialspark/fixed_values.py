"""The registry's vocabularies and the constants results depend on.

Nothing here is logic. Every table is a value that has to be exactly what it is
for counts, labels or keys to come out right, so it is stated as plain text.
"""

from __future__ import annotations

# --- registry vocabularies (fixed values) ------------------------------------

PHASE_TOKENS = ("EARLY_PHASE1", "PHASE1", "PHASE2", "PHASE3", "PHASE4", "NA")

STATUS_TOKENS = (
    "ACTIVE_NOT_RECRUITING",
    "APPROVED_FOR_MARKETING",
    "AVAILABLE",
    "COMPLETED",
    "ENROLLING_BY_INVITATION",
    "NOT_YET_RECRUITING",
    "NO_LONGER_AVAILABLE",
    "RECRUITING",
    "SUSPENDED",
    "TEMPORARILY_NOT_AVAILABLE",
    "TERMINATED",
    "UNKNOWN",
    "WITHDRAWN",
    "WITHHELD",
)

STUDY_TYPE_TOKENS = ("EXPANDED_ACCESS", "INTERVENTIONAL", "OBSERVATIONAL")

SPONSOR_CLASS_TOKENS = (
    "AMBIG", "FED", "INDIV", "INDUSTRY", "NETWORK", "NIH", "OTHER", "OTHER_GOV", "UNKNOWN",
)

INTERVENTION_TYPE_TOKENS = (
    "BEHAVIORAL",
    "BIOLOGICAL",
    "COMBINATION_PRODUCT",
    "DEVICE",
    "DIAGNOSTIC_TEST",
    "DIETARY_SUPPLEMENT",
    "DRUG",
    "GENETIC",
    "OTHER",
    "PROCEDURE",
    "RADIATION",
)

SEARCH_AREAS = ("cond", "intr", "locn", "spons", "term")

# Named search dimension -> search area.
DIMENSION_AREAS = {
    "condition": "cond",
    "country": "locn",
    "drug": "intr",
    "sponsor": "spons",
    "term": "term",
}

YEAR_FENCE = (1900, 2100)

# --- field aliases and the JSON paths behind them (fixed values) ---------------

FIELD_PATHS = {
    "nctId": "protocolSection.identificationModule.nctId",
    "phase": "protocolSection.designModule.phases",
    "studyType": "protocolSection.designModule.studyType",
    "overallStatus": "protocolSection.statusModule.overallStatus",
    "sponsorClass": "protocolSection.sponsorCollaboratorsModule.leadSponsor.class",
    "sponsorName": "protocolSection.sponsorCollaboratorsModule.leadSponsor.name",
    "interventionType": "protocolSection.armsInterventionsModule.interventions[].type",
    "interventionName": "protocolSection.armsInterventionsModule.interventions[].name",
    "country": "protocolSection.contactsLocationsModule.locations[].country",
    "startDate": "protocolSection.statusModule.startDateStruct.date",
    "primaryCompletionDate": "protocolSection.statusModule.primaryCompletionDateStruct.date",
    "completionDate": "protocolSection.statusModule.completionDateStruct.date",
    "studyFirstPostDate": "protocolSection.statusModule.studyFirstPostDateStruct.date",
    "lastUpdatePostDate": "protocolSection.statusModule.lastUpdatePostDateStruct.date",
}

# Chartable date field -> column of the flat study table.
DATE_COLUMNS = {
    "startDate": "start_date",
    "primaryCompletionDate": "primary_completion_date",
    "completionDate": "completion_date",
    "studyFirstPostDate": "first_post_date",
    "lastUpdatePostDate": "last_update_date",
}

NCT_ID_PATTERN = r"^NCT[0-9]{8}\z"

# --- bucket sentinels and labels (fixed values) --------------------------------

MISSING = "MISSING"
UNKNOWN = "UNKNOWN"
UNDATED = "UNDATED"
OTHER = "Other"
SENTINELS = ("MISSING", "NA", "Other", "UNKNOWN")

MISSING_LABEL = "Missing (not reported)"
MISSING_DATE_LABEL = "Missing (no start date)"
UNKNOWN_LABEL = "Unknown"
UNDATED_LABEL = "Unknown (undated)"

PHASE_ORDER = ("MISSING", "NA", "EARLY_PHASE1", "PHASE1", "PHASE2", "PHASE3", "PHASE4")

PHASE_LABELS = {
    "EARLY_PHASE1": "Early Phase 1",
    "PHASE1": "Phase 1",
    "PHASE2": "Phase 2",
    "PHASE3": "Phase 3",
    "PHASE4": "Phase 4",
    "NA": "NA (not applicable)",
}

STATUS_LABELS = {
    "ACTIVE_NOT_RECRUITING": "Active, not recruiting",
    "COMPLETED": "Completed",
    "ENROLLING_BY_INVITATION": "Enrolling by invitation",
    "NOT_YET_RECRUITING": "Not yet recruiting",
    "RECRUITING": "Recruiting",
    "SUSPENDED": "Suspended",
    "TERMINATED": "Terminated",
    "UNKNOWN": "Unknown status",
    "WITHDRAWN": "Withdrawn",
}

INTERVENTION_TYPE_LABELS = {
    "BEHAVIORAL": "Behavioral",
    "BIOLOGICAL": "Biological",
    "COMBINATION_PRODUCT": "Combination Product",
    "DEVICE": "Device",
    "DIAGNOSTIC_TEST": "Diagnostic Test",
    "DIETARY_SUPPLEMENT": "Dietary Supplement",
    "DRUG": "Drug",
    "GENETIC": "Genetic",
    "OTHER": "Other",
    "PROCEDURE": "Procedure",
    "RADIATION": "Radiation",
}

# --- country spellings (fixed values) ------------------------------------------
# Key: white space collapsed, lower case, trailing dots removed.

COUNTRY_ALIASES = {
    "britain": "United Kingdom",
    "czech republic": "Czechia",
    "czechia": "Czechia",
    "great britain": "United Kingdom",
    "holland": "Netherlands",
    "korea, republic of": "South Korea",
    "republic of korea": "South Korea",
    "russia": "Russia",
    "russian federation": "Russia",
    "s. korea": "South Korea",
    "south korea": "South Korea",
    "the netherlands": "Netherlands",
    "u.k": "United Kingdom",
    "u.s": "United States",
    "u.s.a": "United States",
    "uk": "United Kingdom",
    "united states of america": "United States",
    "us": "United States",
    "usa": "United States",
}

# --- human phase text (fixed values) -------------------------------------------

PHASE_UNITS = {
    "0": "EARLY_PHASE1",
    "1": "PHASE1",
    "2": "PHASE2",
    "3": "PHASE3",
    "4": "PHASE4",
    "i": "PHASE1",
    "ii": "PHASE2",
    "iii": "PHASE3",
    "iv": "PHASE4",
}

# --- study duration bins, months, half open; the last one has no end (fixed values)

DURATION_BINS = (
    (0, 6, "0–6 mo"),
    (6, 12, "6–12 mo"),
    (12, 24, "1–2 yr"),
    (24, 48, "2–4 yr"),
    (48, 120, "4–10 yr"),
    (120, None, "10+ yr"),
)

# --- drug and sponsor names (fixed values) -------------------------------------

PLACEBO_MARKERS = ("placebo", "standard of care", "standard care", "best supportive care")

COMBINATION_PATTERN = r"(?iU)\+|/|\bplus\b|\band\b|\bwith\b"

DOSE_PATTERN = (
    r"(?iU)\b\d+(?:[.,]\d+)?\s*"
    r"(?:mg|mcg|ug|g|kg|ml|l|iu|units?|u|%|mmol|nmol|mm|nm|meq|mg/ml|mg/kg|mg/m2)\b"
)

# Trailing words that are not part of the ingredient: salts and esters, dose
# forms, routes and release modifiers.
DRUG_TRAILING_WORDS = (
    "acetate", "besylate", "calcium", "citrate", "dihydrochloride", "fumarate", "hcl",
    "hydrobromide", "hydrochloride", "malate", "maleate", "mesilate", "mesylate", "phosphate",
    "potassium", "sodium", "succinate", "sulfate", "sulphate", "tartrate", "tosylate",
    "capsule", "capsules", "coated", "concentrate", "cream", "drops", "film", "gel", "infusion",
    "injectable", "injection", "lyophilisate", "lyophilized", "ointment", "patch", "powder",
    "solution", "spray", "suspension", "syrup", "tablet", "tablets",
    "delayed", "extended", "immediate", "inhaled", "intramuscular", "intrathecal", "intravenous",
    "iv", "modified", "nasal", "ophthalmic", "oral", "prolonged", "release", "subcutaneous",
    "sublingual", "sustained", "topical",
)

SPONSOR_TRAILING_WORDS = (
    "ab", "ag", "bv", "co", "company", "corp", "corporation", "gmbh", "group", "holdings", "inc",
    "incorporated", "laboratories", "labs", "limited", "llc", "llp", "lp", "ltd", "nv", "pharma",
    "pharmaceutical", "pharmaceuticals", "plc", "sa", "therapeutics",
)

SPONSOR_ALIASES = {"msd": "merck sharp dohme"}

# --- defaults (fixed values) -----------------------------------------------------

EVIDENCE_LIMIT = 20
DRIFT_SHARE = 0.005
DRIFT_TRIALS = 20

# --- texts of results (fixed values) ---------------------------------------------

# Observed total, expected total, difference.
DRIFT_NOTE = "%d trials were counted where %d were expected: %d apart, within tolerance."

OVERLAP_NOTE = "A trial is counted once per value it has, so the bars can sum to more than the trials."
FOLD_NOTE = "Values beyond the largest are folded into one bar."
# Trials counted, all trials.
CUT_NOTE = "The input was cut short: %d of %d trials are counted."
