"""Fixed values of the study, stated as they are."""

# Dates, prices and windows.
INDEX_FLOOR = "2022-02-22"
STAY_END = "2022-04-15"
INPATIENT_END = "2022-04-16"
CLINIC_END = "2022-04-27"
FLAG_DAYS = (7, 14, 21, 28)
FIRST_ADMISSION = 9999999
PAXLOVID_DAY_PRICE = 105.8
MOLNUPIRAVIR_DAY_PRICE = 141.4
FULL_COURSE_DAYS = 5
POSITIVE_RESULTS = ("Detected", "Detected  **")
TRANSFER_STATUSES = ("ACUTE", "CONV.")

# Treatment arms and their labels.
ARM_LABELS = {0: "Did not use", 1: "Paxlovid only", 2: "Molnupiravir only"}
USE_LABELS = {0: "Did not use", 1: "Used Paxlovid/Molnupiravir"}
NO_USE = "Did not use"

# Age bands (label, lowest age, highest age).
AGE_BANDS = (
    ("<60", None, 59),
    ("60-69", 60, 69),
    ("70-79", 70, 79),
    ("80-89", 80, 89),
    (">=90", 90, None),
)

# Health utility by age (lowest age, highest age, weight).
UTILITY_BANDS = (
    (18, 24, 0.938),
    (25, 34, 0.935),
    (35, 44, 0.942),
    (45, 54, 0.925),
    (55, 64, 0.894),
    (65, None, 0.884),
)
UTILITY_DEFAULT = 0.938

# Pay-code rules in order (how, text, class); later ones only when no earlier one holds.
PAYCODE_RULES = (
    ("contains", "DGS", "Non PA"),
    ("contains", "DH", "Non PA"),
    ("contains", "EP", "Non PA"),
    ("contains", "GAZ", "PA"),
    ("contains", "HA", "Non PA"),
    ("contains", "NE", "Non PA"),
    ("equals", "P", "PA"),
    ("equals", "PA", "PA"),
    ("contains", "RH", "Non PA"),
)

# Death-cause groups; "=" codes match whole, the others anywhere in the code.
DEATH_GROUPS = {
    "covid": "=B342 =U071 =J184",
    "sepsis": "=A415 =A419",
    "cancer": "C",
    "benign_neoplasms": "D1 D2 D3 D4",
    "diabetes": "E",
    "dementia": "F",
    "nervous_sys": "G",
    "ischemic_heart": "I20 I21 I22 I23 I24 I25",
    "pulmonary_heart": "I26 I27 I28",
    "other_heart": "I3 I4 I5",
    "stroke": "I6",
    "respiratory": "=B342 =U071 =J184 J",
    "skin": "L",
    "musculoskeletal": "M",
    "genitourinary": "N",
    "shock": "R5",
}
HEART_GROUPS = ("ischemic_heart", "pulmonary_heart", "other_heart")
NAMED_GROUPS = ("diabetes", "ischemic_heart", "pulmonary_heart", "other_heart", "covid", "cancer",
                "stroke", "nervous_sys", "genitourinary")

# Charlson groups, ICD-9-CM prefixes without the dot (Quan et al. 2005).
CHARLSON_PREFIXES = {
    "mi": "410 412",
    "chf": "39891 40201 40211 40291 40401 40403 40411 40413 40491 40493 4254-4259 428",
    "pvd": "0930 4373 440 441 4431-4439 4471 5571 5579 V434",
    "cevd": "36234 430-438",
    "dementia": "290 2941 3312",
    "cpd": "4168 4169 490-505 5064 5081 5088",
    "rheumd": "4465 7100-7104 7140-7142 7148 725",
    "pud": "531-534",
    "mld": "07022 07023 07032 07033 07044 07054 0706 0709 570 571 5733 5734 5738 5739 V427",
    "diab": "2500-2503 2508 2509",
    "diabwc": "2504-2507",
    "hp": "3341 342 343 3440-3446 3449",
    "rend": "40301 40311 40391 40402 40403 40412 40413 40492 40493 582 5830-5837 585 586 5880 V420 V451 V56",
    "canc": "140-172 174-195 200-208 2386",
    "msld": "4560-4562 5722-5728",
    "metacanc": "196-199",
    "aids": "042-044",
}
CHARLSON = tuple(CHARLSON_PREFIXES)
