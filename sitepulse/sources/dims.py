"""The two constant site dimensions (20 rows each, so always safe to broadcast)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# State of each site.
SITE_STATES = {
    1: "Delhi",
    2: "Delhi",
    3: "Haryana",
    4: "Uttar Pradesh",
    5: "Maharashtra",
    6: "Maharashtra",
    7: "Maharashtra",
    8: "Karnataka",
    9: "Karnataka",
    10: "Tamil Nadu",
    11: "Tamil Nadu",
    12: "Gujarat",
    13: "Gujarat",
    14: "Telangana",
    15: "Telangana",
    16: "Punjab",
    17: "West Bengal",
    18: "Kerala",
    19: "Rajasthan",
    20: "Madhya Pradesh",
}

# Latitude, longitude and display name of each site.
SITE_COORDINATES = {
    1: (28.6139, 77.2090, "Delhi Central Station"),
    2: (28.5921, 77.0460, "Delhi West Hub"),
    3: (28.4595, 77.0266, "Gurugram Station"),
    4: (28.5355, 77.3910, "Noida Hub"),
    5: (19.0760, 72.8777, "Mumbai Central"),
    6: (18.5204, 73.8567, "Pune City Station"),
    7: (19.9975, 73.7898, "Nashik Hub"),
    8: (12.9716, 77.5946, "Bangalore Central"),
    9: (12.9592, 77.6974, "Bangalore East Station"),
    10: (13.0827, 80.2707, "Chennai Central"),
    11: (11.0168, 76.9558, "Coimbatore Hub"),
    12: (23.0225, 72.5714, "Ahmedabad Station"),
    13: (21.1702, 72.8311, "Surat Hub"),
    14: (17.3850, 78.4867, "Hyderabad Central"),
    15: (17.4400, 78.3489, "Hyderabad West Station"),
    16: (30.9010, 75.8573, "Ludhiana Station"),
    17: (22.5726, 88.3639, "Kolkata Hub"),
    18: (8.5241, 76.9366, "Trivandrum Station"),
    19: (26.9124, 75.7873, "Jaipur Central"),
    20: (23.2599, 77.4126, "Bhopal Hub"),
}

UNKNOWN_STATE = "Unknown"


def site_states(spark: SparkSession) -> DataFrame:
    """``site_id, state``."""
    rows = ", ".join(f"({site}L, '{state}')" for site, state in SITE_STATES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS states(site_id, state)")


def site_coordinates(spark: SparkSession) -> DataFrame:
    """``site_id, lat, lon, name``."""
    rows = ", ".join(
        f"({site}L, {lat}D, {lon}D, '{name}')" for site, (lat, lon, name) in SITE_COORDINATES.items()
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS places(site_id, lat, lon, name)")
