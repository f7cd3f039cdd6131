"""Fixed values the analyses rely on: word lists, lookup tables, thresholds."""

# Placeholder entries that are not names.
PLACEHOLDERS = ["Baby", "Infant", "Female", "Notnamed", "Stillborn", "Unborn", "Unnamed", "Unknown", "Unkown"]
PLACEHOLDERS_PROFILE = ["Baby", "Infant", "Notnamed", "Unknown", "Unkown", "Unnamed"]
PLACEHOLDERS_PEAKS = ["Baby"]
PLACEHOLDERS_INTERNATIONAL = ["Baby", "Unnamed"]

# World areas of participants' locations and of registers.
PARTICIPANT_AREAS = {
    "Canada": "North America",
    "United States of America": "North America",
    "UK - England and Wales": "Europe",
    "Ireland": "Europe",
    "UK - Scotland": "Europe",
    "Australia": "Oceania",
    "New Zealand": "Oceania",
}
PARTICIPANT_AREAS_WITH_NI = {**PARTICIPANT_AREAS, "Northern Ireland": "Europe"}
REGISTER_AREAS = {
    "Canada": "North America",
    "USA": "North America",
    "England and Wales": "Europe",
    "Ireland": "Europe",
    "Scotland": "Europe",
    "Australia": "Oceania",
    "New Zealand": "Oceania",
}
REGISTER_AREAS_WITH_NI = {**REGISTER_AREAS, "Northern Ireland": "Europe"}
# The two-area variants put Europe and Oceania together.
PARTICIPANT_TWO_AREAS = {k: v if v == "North America" else "Islands" for k, v in PARTICIPANT_AREAS.items()}
REGISTER_TWO_AREAS = {k: v if v == "North America" else "Islands" for k, v in REGISTER_AREAS.items()}

# Demographics form fields and the columns they become.
DEMOGRAPHIC_FIELDS = {
    "Gender free text": "gender_free",
    "Gender Dropdown": "gender_cat",
    "ASB Dropdown": "asb",
    "Familiarity Dropdown": "familiarity",
    "Childhood": "location_childhood",
    "Adulthood": "location_adulthood",
    "Ethnicity-comment": "ethnicity",
    "Lived longest": "location_longest",
    "Biggest influence": "location_influence",
    "Your age": "birthyear",
    "Parent 1": "parent1",
    "Parent 2": "parent2",
    "Grandparent 1": "gpar1",
    "Grandparent 2": "gpar2",
    "Grandparent 3": "gpar3",
    "Grandparent 4": "gpar4",
    "Oldest Child": "child1",
    "Youngest Child": "child2",
    "Oldest Grandchild": "gchild1",
    "Youngest Grandchild": "gchild2",
    "Comment Box": "exp_comment",
}
DEMOGRAPHIC_NUMBERS = ["birthyear", "parent1", "parent2", "gpar1", "gpar2", "gpar3", "gpar4",
                       "child1", "child2", "gchild1", "gchild2"]

# Rating task objects and the columns they become.
RATING_OBJECTS = {
    "Masc Slider": "masc",
    "Fem Slider": "fem",
    "Neut slider": "neut",
    "Text Entry": "comment",
}

# Self-described ethnicities (lower-cased) with a coarse category other than "white".
ETHNICITY_CATEGORIES = {
    "white mixed latinamerican": "other",
    "mixed": "other",
    "pākehā/anglo-indian": "other",
    "hispanic white": "other",
    "white/jewish": "jewish",
    "ashkenazi jewish, white-passing": "jewish",
    "ashkenazi jewish": "jewish",
    "white and jewish": "jewish",
    "white, ashkenazi jewish": "jewish",
    "white, jewish": "jewish",
    "ashkenazi jewish, white": "jewish",
    "white, ashkenazi": "jewish",
    "asian american": "other",
    "i am black but grew up mostly around white people (but my family is black).": "other",
}

# Free-text gender answers and their coarse category, second study.
GENDER_COARSE = {
    "female": "woman",
    "Female": "woman",
    "female ": "woman",
    "cis male": "man",
    "male": "man",
    "Male": "man",
    "Female (cis)": "woman",
    "Woman": "woman",
    "woman": "woman",
    "Cis woman": "woman",
    "cis woman": "woman",
    "(cis)female": "woman",
    "cis female": "woman",
    "f": "woman",
    "she": "woman",
    "femile": "woman",
    "non-binary/gender non-conforming": "nonbinary",
    "Non-binary": "nonbinary",
    "Agender": "nonbinary",
    "agender": "nonbinary",
    "non-binary": "nonbinary",
    "non-binary lesbian": "nonbinary",
    "non binary/afab": "nonbinary",
    "gender agnostic": "nonbinary",
    "Non binary": "nonbinary",
    "Nonbinary": "nonbinary",
    "cis female / questioning nonbinary": "other",
    "non binary woman": "other",
    "femme": "woman",
}
# The first study knew three coarse labels.
GENDER_COARSE_FIRST_STUDY = {
    "female": "female",
    "Female": "female",
    "female ": "female",
    "cis male": "male",
    "male": "male",
    "Male": "male",
    "Female (cis)": "female",
    "Woman": "female",
    "woman": "female",
    "Cis woman": "female",
    "cis woman": "female",
    "(cis)female": "female",
    "cis female": "female",
    "f": "female",
    "she": "female",
    "femile": "female",
}
# Fine category, both studies; everything else is "nonbinary".
GENDER_FINE = {
    "female": "female",
    "Female": "female",
    "female ": "female",
    "cis male": "male",
    "male": "male",
    "Male": "male",
    "Female (cis)": "female",
    "Woman": "woman",
    "woman": "woman",
    "Cis woman": "woman",
    "cis woman": "woman",
    "(cis)female": "female",
    "cis female": "female",
    "f": "female",
    "she": "woman",
    "femile": "female",
    "I don't know": "questioning",
    "cis female / questioning nonbinary": "questioning",
    "feminine": "femme",
    "femenine": "femme",
    "Agender": "agender",
    "agender": "agender",
}

# Markers that are not answers.
END_MARKER = "END OF FILE"
QUESTIONNAIRE_MARKERS = ["BEGIN QUESTIONNAIRE", "END QUESTIONNAIRE"]
TASK_MARKERS = ["BEGIN TASK", "END TASK"]

# Correct practice answers (spreadsheet row, zone, response), one point each.
PRACTICE_KEY = [
    (1, "buttonA", "Someone"),
    (1, "buttonB", "blew bubbles."),
    (3, "buttonA", "They"),
    (3, "buttonB", "did their hair."),
]
