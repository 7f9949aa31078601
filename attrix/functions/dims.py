"""Fixed lookup values the results depend on.

Everything in this module is data, not logic: state names, codes and
regions, coordinates, bin edges and labels, risk thresholds and display
labels.  They are stated once, in their natural order, and turned into Spark
lookups by :mod:`attrix.operators.features`.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the analysed project's tables for equal results.
# ---------------------------------------------------------------------------

# Canonical 19-state table used by the model-ready preparation; the misspelt
# "Nebrasksa" is also accepted and maps to NE.
STATE_NAME_TO_CODE_19 = {
    "Alabama": "AL",
    "California": "CA",
    "Florida": "FL",
    "Georgia": "GA",
    "Idaho": "ID",
    "Maine": "ME",
    "Montana": "MT",
    "Nebraska": "NE",
    "Nebrasksa": "NE",
    "New Jersey": "NJ",
    "New York": "NY",
    "North Carolina": "NC",
    "North Dakota": "ND",
    "South Carolina": "SC",
    "Utah": "UT",
    "Vermont": "VT",
    "Virginia": "VA",
    "Washington": "WA",
    "West Virginia": "WV",
    "Wisconsin": "WI",
}

STATE_CODE_TO_REGION_19 = {
    "AL": "South",
    "CA": "West",
    "FL": "South",
    "GA": "South",
    "ID": "West",
    "ME": "Northeast",
    "MT": "West",
    "NE": "Midwest",
    "NJ": "Northeast",
    "NY": "Northeast",
    "NC": "South",
    "ND": "Midwest",
    "SC": "South",
    "UT": "West",
    "VT": "Northeast",
    "VA": "South",
    "WA": "West",
    "WV": "South",
    "WI": "Midwest",
}

# 50-state tables of the exploration notebook and the app page.
STATE_NAME_TO_CODE_50 = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR",
    "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE",
    "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID",
    "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS",
    "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS",
    "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV",
    "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY",
    "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK",
    "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC",
    "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT",
    "Vermont": "VT", "Virginia": "VA", "Washington": "WA", "West Virginia": "WV",
    "Wisconsin": "WI", "Wyoming": "WY",
}

STATE_NAME_TO_REGION_50 = {
    "Connecticut": "Northeast", "Maine": "Northeast", "Massachusetts": "Northeast",
    "New Hampshire": "Northeast", "Rhode Island": "Northeast", "Vermont": "Northeast",
    "New Jersey": "Northeast", "New York": "Northeast", "Pennsylvania": "Northeast",
    "Illinois": "Midwest", "Indiana": "Midwest", "Michigan": "Midwest",
    "Ohio": "Midwest", "Wisconsin": "Midwest", "Iowa": "Midwest",
    "Kansas": "Midwest", "Minnesota": "Midwest", "Missouri": "Midwest",
    "Nebraska": "Midwest", "North Dakota": "Midwest", "South Dakota": "Midwest",
    "Delaware": "South", "Florida": "South", "Georgia": "South",
    "Maryland": "South", "North Carolina": "South", "South Carolina": "South",
    "Virginia": "South", "West Virginia": "South", "Alabama": "South",
    "Kentucky": "South", "Mississippi": "South", "Tennessee": "South",
    "Arkansas": "South", "Louisiana": "South", "Oklahoma": "South", "Texas": "South",
    "Arizona": "West", "Colorado": "West", "Idaho": "West", "Montana": "West",
    "Nevada": "West", "New Mexico": "West", "Utah": "West", "Wyoming": "West",
    "Alaska": "West", "California": "West", "Hawaii": "West", "Oregon": "West",
    "Washington": "West",
}

# Early notebook: four region sets (District of Columbia included), else "Other".
REGION_SETS_EARLY = {
    "Northeast": ["Maine", "New Hampshire", "Vermont", "Massachusetts", "Rhode Island",
                  "Connecticut", "New York", "New Jersey", "Pennsylvania"],
    "Midwest": ["Ohio", "Indiana", "Illinois", "Michigan", "Wisconsin",
                "Minnesota", "Iowa", "Missouri", "North Dakota", "South Dakota",
                "Nebraska", "Kansas"],
    "South": ["Delaware", "Maryland", "District of Columbia", "Virginia", "West Virginia",
              "North Carolina", "South Carolina", "Georgia", "Florida",
              "Kentucky", "Tennessee", "Alabama", "Mississippi",
              "Arkansas", "Louisiana", "Oklahoma", "Texas"],
    "West": ["Montana", "Idaho", "Wyoming", "Colorado", "New Mexico",
             "Arizona", "Utah", "Nevada", "Washington", "Oregon",
             "California", "Alaska", "Hawaii"],
}
REGION_OTHER = "Other"

REGION_COORDS = {
    "West": {"lat": 39, "lon": -118},
    "Midwest": {"lat": 41, "lon": -93},
    "South": {"lat": 33, "lon": -86},
    "Northeast": {"lat": 42, "lon": -74},
}

LOCATION_CORRECTIONS = {"Nebrasksa": "Nebraska"}

INQUIRY_ORDINALS = {"Low": 0, "Medium": 1, "High": 2}

# Bins: (edges, labels).
AGE_EDGES = [18, 25, 35, 50, 65, 80]
AGE_LABELS = ["18-24", "25-34", "35-49", "50-64", "65-79"]
HOURS_EDGES = [0, 5, 10, 20, 30, 40, 50]
HOURS_LABELS = ["0-5", "5-10", "10-20", "20-30", "30-40", "40-50"]
HOURS_EDGES_OPEN = [0, 5, 10, 40, 50, float("inf")]
HOURS_LABELS_OPEN = ["0-5", "5-10", "10-40", "40-50", ">50"]
SKIP_EDGES_LEFT = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0000001]
SKIP_EDGES_RIGHT = [0, 0.2, 0.4, 0.6, 0.8, 1.0]
SKIP_LABELS = ["0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0"]
TENURE_EDGES = [0, 3, 12, 24, 60]
TENURE_LABELS = ["0-3", "3-12", "12-24", "24-60"]

HIGH_SKIP_THRESHOLD = 0.7

# Risk classes: p < 0.33 low, p < 0.66 medium, else high (also for null).
RISK_LOW_BELOW = 0.33
RISK_MEDIUM_BELOW = 0.66
RISK_LOW, RISK_MEDIUM, RISK_HIGH = "Bajo", "Medio", "Alto"
RISK_ORDER = [RISK_LOW, RISK_MEDIUM, RISK_HIGH]
RISK_ALL = "Todos"

TARGET_LABELS = {1: "Churn", 0: "No churn"}

CATEGORICAL_FEATURES = [
    "location",
    "subscription_type",
    "payment_plan",
    "payment_method",
    "customer_service_inquiries",
    "age_group",
    "weekly_hours_bin",
    "skip_rate_bin",
    "state_code",
    "region",
]

SEGMENT_CANDIDATES = [
    "subscription_type",
    "customer_service_inquiries",
    "region",
    "risk_segment_rule",
    "age_group",
    "state_code",
]

NUMERIC_PLOT_CANDIDATES = [
    "weekly_hours",
    "song_skip_rate",
    "num_subscription_pauses",
    "age",
    "average_session_length",
    "weekly_unique_songs",
    "weekly_songs_played",
    "engagement_index",
]

DISPLAY_LABELS = {
    "age": "Edad",
    "subscription_type": "Tipo de suscripción",
    "weekly_hours": "Horas semanales",
    "song_skip_rate": "Tasa de salto de canciones",
    "num_subscription_pauses": "N.º de pausas de suscripción",
    "customer_service_inquiries": "Consultas a atención al cliente",
    "average_session_length": "Duración media de sesión",
    "weekly_unique_songs": "Canciones únicas por semana",
    "weekly_songs_played": "Canciones reproducidas por semana",
    "notifications_clicked": "Notificaciones pulsadas",
    "location": "Ubicación",
    "state_code": "Estado",
    "region": "Región",
    "tenure_days": "Antigüedad (días)",
    "tenure_months": "Antigüedad (meses)",
    "songs_per_hour": "Canciones por hora",
    "high_skip_user": "Usuario con alto skip",
    "age_group": "Grupo de edad",
    "weekly_hours_bin": "Tramo de horas semanales",
    "skip_rate_bin": "Tramo de tasa de salto",
    "engagement_index": "Índice de engagement",
    "is_free_plan": "Plan gratuito",
    "is_high_inquiries": "Muchas consultas a soporte",
    "churned": "Churn observado",
    "p_churn": "Probabilidad de churn",
    "risk_level": "Nivel de riesgo",
    "source": "Origen",
    "model_used": "Modelo usado",
}

FEATURE_NAME_PREFIXES = ["num__", "cat__"]

# Default random forest of the final training step.
DEFAULT_RF_PARAMS = {
    "n_estimators": 300,
    "max_depth": 12,
    "min_samples_split": 10,
    "min_samples_leaf": 2,
    "max_features": None,
    "class_weight": None,
    "random_state": 42,
}

POOL_SIZE = 1000
RANDOM_STATE = 42
TARGET = "churned"
