"""The lists that test persons are drawn from."""

FIRST_NAMES = (
    "Anne", "Ann", "Jon", "John", "Maria", "Marie", "Catherine", "Katherine", "Steven", "Stephen",
    "Christopher", "Kristopher", "Sara", "Sarah", "Alexandria", "Alexandra", "Brian", "Bryan", "Jeffrey", "Geoffrey",
    "Elizabeth", "Elisabeth", "Theresa", "Teresa", "Mohammed", "Mohamed", "Nicholas", "Nicolas", "Rebecca", "Rebekah",
    "Michael", "Micheal", "José", "Jose", "Deborah", "Debra", "Guadalupe", "Wilhelmina", "Wilhelmine", " Lee ",
)

LAST_NAMES = (
    "Smith", "Smyth", "Johnson", "Johnston", "Brown", "Browne", "Clark", "Clarke", "Gonzalez", "Gonzales",
    "Rodriguez", "Rodrigues", "Hernandez", "Fernandez", "Thompson", "Thomson", "Peterson", "Petersen", "Nguyen", "Martinez",
    "Martines", "O'Brien", "OBrien", "Williams", "Williamson", "Fitzgerald", "Montgomery", "Montgomerie", "Lee", "Leigh",
    "Meyer", "Myers", "Schwarz", "Schwartz", "Núñez", "Nunez", "Washington", "McDonald", "MacDonald", "Van Buren",
)

# Field -> values and the factor of the draw.
DEMOGRAPHICS = {
    "sex_at_birth": (("M", "F", "X", "U", "m", "Intersex", "", None), 3),
    "gender_identity": (
        (
            "Male", "Cis man", "Man/Woman", "Woman", "woman (cis)", "Female", "Trans man", "Transgender female", "Non-Binary",
            "Genderqueer", "enby", " male ", "F", "human", "Mankind", "non binary", "   ", None, "Nonbinary",
        ),
        5,
    ),
    "ethnicity": (
        ("Hispanic", "Latina", "Not Hispanic or Latino", "Non-Hispanic", "Platinum", "Declined", " ", None, "Unknown"),
        7,
    ),
    "race": (
        (
            "Caucasian", "Asian", "White", "Black", "African American", "Middle Eastern/North African",
            "Multiracial: Black/White", "Native Hawaiian", "Other Pacific", "American Indian", "Native American",
            "Alaska Native", "Middle Eastern", "Two or more", "MENA", "Declined", "", None, "Multiple",
        ),
        11,
    ),
    "primary_language": (
        ("English", "english", "Spanish", " Spanish", "Somali", "Vietnamese", "Arabic, Levantine", "", None, "Kreyòl", "ASL"),
        13,
    ),
    "marital_status": (("Single", "Married", "Divorced", "Widowed", "Partner \"other\"", "  ", None), 17),
}
