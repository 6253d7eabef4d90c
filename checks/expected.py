"""What the reports must show, written down apart from the package under test: the class of every raw value, names and bases."""

from __future__ import annotations

# The class that each raw value of the test persons must get, told value by value; no value at all is UNKNOWN.
UNKNOWN = "Unknown/Blank"
CLASSES = {
    "sex_at_birth": {"M": "M", "F": "F", "X": "X", "U": "U", "m": "Other/Unmapped", "Intersex": "Other/Unmapped", "": UNKNOWN},
    "gender_identity": {
        "Male": "Male",
        "Cis man": "Male",
        "Man/Woman": "Male",
        "Woman": "Female",
        "woman (cis)": "Female",
        "Female": "Female",
        "Trans man": "Transgender",
        "Transgender female": "Transgender",
        "Non-Binary": "Non-binary / Genderqueer",
        "Nonbinary": "Non-binary / Genderqueer",
        "Genderqueer": "Non-binary / Genderqueer",
        "enby": "Non-binary / Genderqueer",
        " male ": "Other/Unmapped",
        "F": "Other/Unmapped",
        "human": "Other/Unmapped",
        "Mankind": "Other/Unmapped",
        "non binary": "Other/Unmapped",
        "   ": UNKNOWN,
    },
    "ethnicity": {
        "Hispanic": "Latino/Hispanic",
        "Latina": "Latino/Hispanic",
        "Not Hispanic or Latino": "Latino/Hispanic",
        "Non-Hispanic": "Latino/Hispanic",
        "Platinum": "Latino/Hispanic",
        "Declined": "Not Latino/Hispanic",
        "Unknown": "Not Latino/Hispanic",
        " ": UNKNOWN,
    },
    "race": {
        "Caucasian": "Asian",
        "Asian": "Asian",
        "White": "White",
        "Black": "Black/African American",
        "African American": "Black/African American",
        "Middle Eastern/North African": "Black/African American",
        "Multiracial: Black/White": "Black/African American",
        "Native Hawaiian": "Native Hawaiian/Pacific Islander",
        "Other Pacific": "Native Hawaiian/Pacific Islander",
        "American Indian": "American Indian/Alaska Native",
        "Native American": "American Indian/Alaska Native",
        "Alaska Native": "American Indian/Alaska Native",
        "Middle Eastern": "Middle Eastern/North African",
        "Two or more": "Multiracial/Two+",
        "Multiple": "Multiracial/Two+",
        "MENA": "Other/Unmapped",
        "Declined": "Other/Unmapped",
        "": UNKNOWN,
    },
}

# Report category, kind of its values, column.
CATEGORIES = {
    "age_group": ("age", "dob"),
    "sex_at_birth": ("classes", "sex_at_birth"),
    "gender_identity_grouped": ("classes", "gender_identity"),
    "gender_identity_raw": ("raw", "gender_identity"),
    "ethnicity_grouped": ("classes", "ethnicity"),
    "ethnicity_raw": ("raw", "ethnicity"),
    "race_grouped": ("classes", "race"),
    "race_raw": ("raw", "race"),
    "primary_language": ("raw", "primary_language"),
    "marital_status": ("raw", "marital_status"),
}

# Completeness rows and the column each counts as missing.
COMPLETENESS = {
    "Missing DOB": "dob",
    "Missing Race": "race",
    "Missing Ethnicity": "ethnicity",
    "Missing Gender Identity": "gender_identity",
    "Missing Sex at Birth": "sex_at_birth",
}

# Report columns, the uses that each needs together, and the column that a percentage is of.
MEASURES = {
    "pantry_served_total": ("pantry_served",),
    "clinic_served_total": ("clinic",),
    "pharmacy_served_total": ("pharmacy",),
    "pharmacy_and_pantry": ("pharmacy", "pantry"),
    "pharmacy_and_household_pantry": ("pharmacy", "pantry_served"),
    "clinic_and_household_pantry": ("clinic", "pantry_served"),
    "clinic_and_pharmacy": ("clinic", "pharmacy"),
}
BASES = {
    "pharmacy_and_pantry": "pharmacy_served_total",
    "pharmacy_and_household_pantry": "pharmacy_served_total",
    "clinic_and_household_pantry": "clinic_served_total",
    "clinic_and_pharmacy": "clinic_served_total",
}
