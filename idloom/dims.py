"""Fixed values of the domain as plain Python data and small DataFrames of constant size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Document kinds in canonical order, and the sides that each must show.
KINDS = ["dz-id", "dz-driving-licence", "dz-passport"]
SIDES = {"dz-id": ["front", "back"], "dz-driving-licence": ["front", "back"], "dz-passport": ["single"]}
FINAL = ["succeeded", "document_failed", "consistency_failed", "technical_failed", "expired"]
MINUTES_IDLE, DAYS_KEPT, MAX_ATTEMPTS, MAX_SUBMISSIONS, LEASE_MS, SWEEP_ROWS = 30, 30, 3, 10, 240_000, 100

# Policies as (id, label, selection, documents, least number).
POLICIES = [
    ("id-only", "National identity card", "all", ["dz-id"], 1),
    ("passport-only", "Passport", "all", ["dz-passport"], 1),
    ("licence-only", "Driving licence", "all", ["dz-driving-licence"], 1),
    ("id-and-passport", "Identity card and passport", "all", ["dz-id", "dz-passport"], 2),
    ("id-and-licence", "Identity card and driving licence", "all", ["dz-driving-licence", "dz-id"], 2),
    ("licence-and-passport", "Driving licence and passport", "all", ["dz-driving-licence", "dz-passport"], 2),
    ("two-of-three", "Two identity documents", "minimum", ["dz-id", "dz-driving-licence", "dz-passport"], 2),
    ("all-three", "All identity documents", "all", ["dz-id", "dz-driving-licence", "dz-passport"], 3),
]

# Canonical fields and the raw names that may hold them, best first.
ALIASES = {
    "lastNameLatin": ["lastNameLatin", "surname_latin", "last_name_latin", "nom_latin", "surname"],
    "firstNameLatin": ["firstNameLatin", "given_name_latin", "first_name_latin", "prenom_latin", "given_names"],
    "lastNameArabic": ["lastNameArabic", "surname_ar", "last_name_arabic", "nom_arabe", "nom_ar"],
    "firstNameArabic": ["firstNameArabic", "given_name_ar", "first_name_arabic", "prenom_arabe", "prenom_ar"],
    "nin": ["nin", "personal_number", "national_identification_number", "numero_identification_national"],
    "documentNumber": ["documentNumber", "document_number", "front_document_number", "back_document_number", "license_number", "serial_number", "numero_document", "passport_number"],
    "dateOfBirth": ["dateOfBirth", "date_of_birth", "date_naissance"],
    "expiryDate": ["expiryDate", "date_of_expiry", "expiry_date", "front_date_of_expiry_printed", "back_date_of_expiry_printed", "date_expiration", "date_fin_validite"],
}

# Identity facts that are compared across documents, with their names and the kind of comparison.
IDENTITY_FACTS = [
    ("nin", ["nin", "personal_number"], "identifier"),
    ("dateOfBirth", ["dateOfBirth", "date_of_birth"], "date"),
    ("sex", ["sex"], "sex"),
    ("lastNameLatin", ["lastNameLatin", "surname_latin"], "latin"),
    ("firstNameLatin", ["firstNameLatin", "given_name_latin"], "latin"),
    ("lastNameArabic", ["lastNameArabic", "surname_ar"], "arabic"),
    ("firstNameArabic", ["firstNameArabic", "given_name_ar"], "arabic"),
]

# Fields that mean the same on both faces.
COMPARABLE = {
    "dz-id": ["date_of_birth", "sex", "date_of_expiry", "nin", "surname_latin", "given_name_latin", "surname_ar", "given_name_ar"],
    "dz-driving-licence": ["license_number", "surname_latin", "given_name_latin", "date_of_birth", "sex", "date_of_expiry", "nin"],
}
# Fields that are checked while a person is being onboarded.
ONBOARDING = ["nin", "date_of_birth", "surname_latin", "given_name_latin", "surname_ar", "given_name_ar", "dateOfBirth", "lastNameLatin", "firstNameLatin", "lastNameArabic", "firstNameArabic"]
# Checks that never count for coverage.
NOT_COVERAGE = ["cross.id.names", "cross.id.document_number", "cross.id.national_number", "cross.driving_licence.national_number", "cross.coverage"]

# Face checks as (id, field, kind of comparison, name comparison).
FACE_RULES = {
    "dz-id": [
        ("cross.id.birth_date", "date_of_birth", "date", False),
        ("cross.id.sex", "sex", "sex", False),
        ("cross.id.expiry", "date_of_expiry", "date", False),
        ("cross.id.national_number", "nin", "identifier", False),
        ("cross.id.surname_ar", "surname_ar", "arabic", True),
        ("cross.id.given_name_ar", "given_name_ar", "arabic", True),
        ("cross.id.surname_latin", "surname_latin", "latin", True),
        ("cross.id.given_name_latin", "given_name_latin", "latin", True),
    ],
    "dz-driving-licence": [
        ("cross.driving_licence.license_number", "license_number", "text", False),
        ("cross.driving_licence.birth_date", "date_of_birth", "date", False),
        ("cross.driving_licence.sex", "sex", "sex", False),
        ("cross.driving_licence.expiry", "date_of_expiry", "date", False),
        ("cross.driving_licence.surname", "surname_latin", "latin", True),
        ("cross.driving_licence.given_name", "given_name_latin", "latin", True),
        ("cross.driving_licence.national_number", "nin", "identifier", False),
    ],
    "id-passport": [
        ("cross.person.national_number", "nin", "identifier", False),
        ("cross.person.birth_date", "date_of_birth", "date", False),
        ("cross.person.sex", "sex", "sex", False),
        ("cross.person.surname_ar", "surname_ar", "arabic", True),
        ("cross.person.given_name_ar", "given_name_ar", "arabic", True),
        ("cross.person.place_of_birth_ar", "place_of_birth_ar", "arabic", True),
    ],
}
# The names that hold a compared field on the first and on the second face, best first (default: its own).
FACE_NAMES = {
    "dz-id": {"nin": (["nin", "personal_number"], ["nin", "personal_number"])},
    "dz-driving-licence": {"nin": (["nin", "personal_number"], ["nin", "personal_number"])},
    "id-passport": {"nin": (["nin"], ["personal_number"])},
}
NAME_FLOOR = 0.75

# Identity facts whose side is traced for the comparison across documents, with the names after their own.
TRACED = {
    "lastNameLatin": ["surname_latin", "last_name_latin"],
    "firstNameLatin": ["given_name_latin", "first_name_latin"],
    "lastNameArabic": ["surname_ar", "last_name_ar"],
    "firstNameArabic": ["given_name_ar", "first_name_ar"],
    "nin": ["nin", "personal_number"],
    "dateOfBirth": ["date_of_birth", "birth_date"],
    "sex": ["sex", "gender"],
}

# Identifiers that settle whether two readings are of one holder, and names that may.
STRONG_KEYS = ["nin", "document_number", "license_number", "passport_number", "serial_number"]
NAME_KEYS = ["surname_ar", "surname_latin", "given_name_ar", "given_name_latin"]
REQUIRED = ["lastNameLatin", "firstNameLatin", "nin", "dateOfBirth"]
EITHER_SCRIPT = {"lastNameLatin": ["lastNameLatin", "lastNameArabic"], "lastNameArabic": ["lastNameLatin", "lastNameArabic"], "firstNameLatin": ["firstNameLatin", "firstNameArabic"], "firstNameArabic": ["firstNameLatin", "firstNameArabic"]}

# The order in which fields are shown, and fields that are not shown.
SHOWN = [
    "passport_number", "license_number", "document_number", "serial_number", "nin", "personal_number",
    "surname_latin", "given_name_latin", "surname_ar", "given_name_ar", "date_of_birth", "date_of_birth_printed",
    "place_of_birth_latin", "place_of_birth_ar", "sex", "nationality", "blood_group", "categories",
    "date_of_issue", "date_of_issue_printed", "date_of_expiry", "date_of_expiry_printed",
    "issuing_authority_latin", "issuing_authority_ar", "issuing_country", "document_type", "category_entries", "restrictions",
]
HIDDEN = ["mrz_line_1", "mrz_line_2", "mrz_line_3"]
HIDDEN_LICENCE = ["date_of_birth_printed", "date_of_issue_printed", "date_of_expiry_printed", "front_date_of_expiry_printed", "back_date_of_expiry_printed", "category_entries"]

# Default quality limits and what each check does when it is not met.
PROFILE = {
    "edgeMargin": 0.012, "minFill": 0.6, "maxFill": 0.97, "aspectTolerance": 0.14, "maxAngleDeviation": 14.0, "maxSideRatio": 1.22, "minDpi": 220.0,
    "maxCornerMotion": 0.012, "minSharpness": 40.0, "minSharpnessLive": 40.0, "minMotionIsotropy": 0.3, "minFocusUniformity": 0.15,
    "exposureMin": 105.0, "exposureMax": 225.0, "maxHighlightClip": 0.04, "maxShadowClip": 0.12, "minContrast": 0.35,
    "maxGlareRatio": 0.012, "maxGlareBlob": 0.006, "minColorGlareValue": 220.0, "minColorGlareSaturation": 0.25, "maxColorGlareRatio": 0.03,
    "minIllumination": 0.62, "maxNoise": 6.0,
}
SEVERITY = {
    "document_found": "block", "document_inside": "block", "document_fill": "block", "aspect_ratio": "block", "perspective": "block", "resolution": "block",
    "stability": "block", "sharpness": "block", "motion_blur": "warn", "focus_uniformity": "warn", "exposure": "block", "highlights": "block",
    "shadows_clipped": "warn", "contrast": "warn", "glare": "block", "color_glare": "warn", "illumination": "block", "noise": "warn",
}


# Default limits of template matching.
ORB = {"ratioThreshold": 0.75, "minimumGoodMatches": 18, "minimumInlierRatio": 0.42, "ransacThreshold": 4.0, "minSpatialCoverage": 0.08, "maxReprojectionError": 8.0}

# What a hint tells the person who holds the camera.
HINTS = {
    "find_document": "Place the document on a plain, contrasting surface",
    "show_whole_document": "Keep every edge and corner inside the frame",
    "move_closer": "Move closer so the document fills the frame",
    "move_back": "Move back slightly so the whole document is visible",
    "wrong_document": "Show the expected document, flat and unfolded",
    "hold_parallel": "Hold the phone parallel to the document",
    "hold_still": "Hold the phone still",
    "focus": "Hold still and let the camera focus",
    "more_light": "Move to a brighter place",
    "less_light": "Reduce the light or avoid direct sunlight",
    "avoid_glare": "Tilt the document slightly to remove reflections",
    "even_light": "Move the document into even light, without shadows",
    "ready": "Capture is ready",
}

# Least and greatest value of each number of a profile, whether it is whole, and whether it may be missing.
PROFILE_BOUNDS = [
    ("capture.samplingIntervalMs", 60, 5000, True, False), ("capture.analysisSize", 480, 2560, True, False), ("capture.stableFrames", 1, 20, True, False),
    ("capture.maxCornerMotion", 0.001, 0.2, False, False), ("capture.burstFrames", 1, 8, True, False), ("capture.idealVideoWidth", 640, 8000, True, False),
    ("capture.jpegQuality", 0.5, 1, False, False),
    ("document.minFill", 0, 1, False, False), ("document.maxFill", 0, 1, False, False), ("document.edgeMargin", 0, 0.3, False, False),
    ("document.aspectTolerance", 0, 1, False, False), ("document.maxAngleDeviation", 0, 45, False, False), ("document.maxSideRatio", 1, 3, False, False),
    ("document.minDpi", 50, 1200, False, False),
    ("image.minSharpness", 0, 100000, False, False), ("image.minSharpnessLive", 0, 100000, False, False), ("image.minMotionIsotropy", 0, 1, False, False),
    ("image.minFocusUniformity", 0, 1, False, False), ("image.exposureMin", 0, 254, False, False), ("image.exposureMax", 1, 255, False, False),
    ("image.maxHighlightClip", 0, 1, False, False), ("image.maxShadowClip", 0, 1, False, False), ("image.minContrast", 0, 1, False, False),
    ("image.maxGlareRatio", 0, 1, False, False), ("image.maxGlareBlob", 0, 1, False, False), ("image.minColorGlareValue", 0, 255, True, True),
    ("image.minColorGlareSaturation", 0, 1, False, True), ("image.maxColorGlareRatio", 0, 1, False, True), ("image.minIllumination", 0, 1, False, False),
    ("image.maxNoise", 0, 100, False, False),
    ("preprocess.targetDpi", 150, 800, True, False), ("preprocess.marginRatio", 0, 0.1, False, False), ("preprocess.illuminationStrength", 0, 1, False, False),
    ("preprocess.claheClipLimit", 0, 8, False, False), ("preprocess.claheTileGrid", 2, 32, True, False), ("preprocess.denoiseAboveNoise", 0, 100, False, False),
    ("preprocess.sharpenAmount", 0, 3, False, False), ("preprocess.sharpenSigma", 0.3, 5, False, False), ("preprocess.jpegQuality", 60, 100, True, False),
    ("orb.ratioThreshold", 0.1, 0.99, False, False), ("orb.minimumGoodMatches", 4, 500, True, False), ("orb.minimumInlierRatio", 0, 1, False, False),
    ("orb.ransacThreshold", 0.1, 50, False, False), ("orb.minSpatialCoverage", 0, 1, False, False), ("orb.maxReprojectionError", 0.1, 100, False, False),
    ("orb.projectionMinAreaRatio", 0.01, 10, False, False), ("orb.projectionMaxAreaRatio", 0.01, 10, False, False), ("orb.projectionMarginRatio", 0, 2, False, False),
]
PROFILE_SWITCHES = ["capture.autoCapture", "capture.stillCapture", "preprocess.enabled", "preprocess.whiteBalance"]
# Pairs of which the first must be less than the second.
PROFILE_ORDER = [("document.minFill", "document.maxFill"), ("image.exposureMin", "image.exposureMax"), ("orb.projectionMinAreaRatio", "orb.projectionMaxAreaRatio")]


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "policy_id string, label string, selection string, documents array<string>, least int")


def sides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i, s) for k in KINDS for i, s in enumerate(SIDES[k])], "kind string, pos int, side string")


def aliases(spark: SparkSession, table: dict[str, list[str]] | None = None) -> DataFrame:
    """(canonical, name, rank) with the front and back forms of each raw name after it."""
    rows = [(c, form, 3 * i + j) for c, names in (table or ALIASES).items() for i, n in enumerate(names) for j, form in enumerate((n, f"front_{n}", f"back_{n}"))]
    return spark.createDataFrame(rows, "canonical string, name string, rank int")


def traced(spark: SparkSession) -> DataFrame:
    """:func:`aliases` of the traced facts: the fact's own name comes first."""
    return aliases(spark, {f: list(dict.fromkeys([f, *names])) for f, names in TRACED.items()})
