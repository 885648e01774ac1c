"""Fixed values of the aid-declaration vocabulary.

Everything in this module is a literal that results depend on: column names,
label spellings, bounds and sentence fragments. No logic lives here; operators
take all of it as parameters.
"""

# Column names of the declaration table.
PROJECT_KEY = "Num identification SNPC"
COMMITMENT_DATE = "Date d'engagement"
DECLARATION_YEAR = "Annee de declaration"
COMMITTED = "Engagements (K EUR)"
GRANT_EQUIVALENT = "Equivalent don (K EUR)"
PAID = "Montant verse (K EUR)"
AGENCY = "Agence"
COUNTRY = "Pays beneficiaire"
REGION = "Région"
SECTOR = "Secteur"
FINANCING_TYPE = "Type de financement"
CHANNEL = "Canal de transfert"
CHANNEL_GROUP = "Canal agrege"
MOBILISED_ORIGIN = "Origine des fonds mobilises"

# Columns derived by the datasets.
COMMITMENT_DAY = "date_engagement"
COMMITMENT_YEAR = "annee_engagement"
COMMITMENT_MONTH = "mois_engagement"
GRANT_RATIO = "ratio_don"
FINANCING_CLASS = "type_fin_agrege"
LOG_PAID = "log_montant"
LOG_COMMITTED = "log_engagements"

# Name fragments of amount columns and of dropped columns.
AMOUNT_UNITS = ["K EUR", "K USD", "M EUR", "M USD"]
DOLLAR_FRAGMENT = "USD"
DOLLAR_UNIT_FRAGMENT = "(K USD)"
CODE_PATTERN = "code|Code|Codes|codes"

# Policy markers turned into 0/1.
MARKERS = [
    "Genre",
    "Aide a l'environnement",
    "Gouvernance",
    "Biodiversite",
    "Attenuation du changement climatique",
    "Adaptation au changement climatique",
    "Desertification",
    "Santé genesique, maternelle, neonatale et infantile (SGMNI)",
    "Reduction du risque de catastrophe",
    "Nutrition",
    "Inclusion des personnes en situation de handicap",
    "FTC",
]

# Markers the tracked trainer encodes as categories.
CATEGORY_MARKERS = [
    "Genre",
    "Aide a l'environnement",
    "Gouvernance",
    "Biodiversite",
    "Attenuation du changement climatique",
    "Adaptation au changement climatique",
    "Desertification",
    "Développement du commerce",
    "Santé genesique, maternelle, neonatale et infantile (SGMNI)",
]

# Columns the exploration dataset does not keep.
REDUNDANT_CODES = [
    "Code agence",
    "Code nature de l'activite",
    "Code du pays beneficiaire",
    "Code canal de transfert",
    "Code canal parent",
    "Bi/Multi",
    "Code type de flux",
    "Code type de financement",
    "Code modalite de cooperation",
    "Code objet",
    "Code aide regionale aux PMA",
    "Code outil de mobilisation des flux prives",
    "Code origine des fonds mobilises",
    "Code profil de remboursement",
    "Code Marqueur ISP",
    "code secteur CAD",
]
IDENTIFIERS = ["Numero de projet", "Codes ISO"]
LONG_TEXTS = [
    "Description courte",
    "Description",
    "Mots cles",
    "Description de l'additionnalite",
    "Additionnalite - objectif de développement",
]
OTHER_DATES = [
    "Date prevue de lancement",
    "Date prevue de fin",
    "Date de premier remboursement",
    "Date finale de remboursement ou echeance attendue pour les actions",
]
MISCELLANEOUS = ["Localisation geographique", "Type de finance mixte"]
MILLION_AMOUNTS = ["Montant versé (M EUR)", "Équivalent don (M EUR)"]

# Label merges of the exploration dataset.
EXPLORE_LABELS = {
    "Canal de transfert": {
        "Cités Unies Frances": "Cités Unies France",
        "Gouvernment central": "Gouvernement central",
        "Central Government": "Gouvernement central",
        "Gouvernment local": "Gouvernement local",
        "ONG INTERNATIONALE": "ONG internationale",
        "ONG internationales": "ONG internationale",
        "Other public entities in donor country": "Autre entité publique dans le pays donneur",
        "Institutions du Secteur Privé": "Institutions du secteur privé",
        "Réseaux": "Réseau",
        "RÉSEAU": "Réseau",
        "Agence, fonds ou commission des Nations Unies (ONU)": "Agence, fonds ou commission des Nations unies (NU)",
        "INTERNATIONAL UNION FOR CONSERVATION OF NATURE": "Union internationale pour la conservation de la nature",
        "ACTION AGAINST HUNGER": "Action contre la faim",
        "ACTION CONTRE LA FAIM": "Action contre la faim",
        "ACTION CONTRE LA FAIM Espagne": "Action contre la faim",
        "Fundacion Accion contra el hambre": "Action contre la faim",
    },
    "Canal agrege": {
        "Agence, fonds ou commission des Nations Unies (NU)": "Agence, fonds ou commission des Nations unies (NU)",
        "Groupe de la Banque Mondiale (BM)": "Groupe de la Banque mondiale (BM)",
        "Fonds Monétaire International (FMI)": "Fonds monétaire international (FMI)",
    },
    "Agence": {
        "Ministère de l'enseignement supérieur et de la recherche (MESR)": "Ministère de l'enseignement supérieur et de la recherche",
        "Ministère de l'économie et des finances": "Ministère de l'économie, des finances, et de la souveraineté industrielle",
    },
    "Pays beneficiaire": {"Türkiye": "Turquie"},
}

# Label merges of the modelling dataset (the channel groups go the
# other way round than in the exploration dataset).
MODEL_LABELS = {
    "Pays beneficiaire": {"Türkiye": "Turquie"},
    "Canal agrege": {
        "Agence, fonds ou commission des Nations unies (NU)": "Agence, fonds ou commission des Nations Unies (NU)",
        "Fonds monétaire international (FMI)": "Fonds Monétaire International (FMI)",
        "Groupe de la Banque mondiale (BM)": "Groupe de la Banque Mondiale (BM)",
    },
}

# Financing classes.
GRANT_LABEL = "Dons"
LOAN_LABEL = "Prêt"
GRANT_CLASS = "Don"
LOAN_CLASS = "Prêt"
OTHER_CLASS = "Autre"

# Feature lists.
RATIO_CATEGORIES = [
    "Agence",
    "Type de financement",
    "Modalités agrégées",
    "Catégorie CAD",
    "Région",
    "Bi/Multi.1",
    "Canal agrege",
    "Secteur",
]
RATIO_NUMBERS = ["Annee de declaration", "mois_engagement"]
HOURLY_CATEGORIES = [
    "Agence",
    "Type de financement",
    "Pays beneficiaire",
    "Région",
    "Secteur",
    "Catégorie CAD",
    "Bi/Multi",
]
HOURLY_NUMBERS = ["Annee de declaration"]
MISSING_CATEGORY = "inconnu"

# Amount bands, upper bounds on the log scale, and their labels.
BAND_BOUNDS = [1.792, 2.852, 5.017]
BAND_LABELS = [
    "Petit (≤ 5 K EUR)",
    "Moyen (5 – 16 K EUR)",
    "Grand (16 – 150 K EUR)",
    "Très grand (> 150 K EUR)",
]

# Candidate models in the order that breaks ties.
CANDIDATES = ["LinearRegression", "DecisionTreeRegressor", "RandomForestRegressor"]
PROMOTION_MARGIN = 0.995

# Date formats of the two cleaning scripts, and read markers of
# missing text (the defaults of pandas.read_csv).
DAY_FIRST_FORMATS = ["d/M/yyyy", "d-M-yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]
DEFAULT_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy", "M-d-yyyy"]
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Chart contract and wording of the summary sentence.
CHART_TYPES = ["bar", "line", "pie", "scalar", "table"]
CHART_LIMIT = 15
DROPDOWN_LIMIT = 200
EMPTY_SUMMARY = "Aucune donnée à afficher."
