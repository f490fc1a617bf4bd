"""Fixed values.

Every list below must equal the published data's own spelling for results to be right; they are
stated in natural order and are not derived from anything else.
"""

# --- measures of the normalised income tables -------------------------------------------------
AGI = "agi_of_all_returns"
LIABILITY = "tax_liability_of_all_returns"
RETURNS = "number_of_all_returns"
MEASURES = [AGI, LIABILITY, RETURNS]

# The words before and after the mean rate in the caption of a year's effective rates.
RATE_CAPTION = "The average share for all income\ngroups was", "percent in"

# --- counties of the Metropolitan Commuter Transportation District ----------------------------
DOWNSTATE = [
    "New York", "Bronx", "Kings", "Queens", "Richmond", "Rockland",
    "Nassau", "Suffolk", "Orange", "Putnam", "Dutchess", "Westchester",
]

# The five counties of New York City; sales data has no row of their own for them.
CITY_COUNTIES = ["Richmond", "Queens", "Kings", "New York", "Bronx"]

# --- rows of the income tables that are not counties ------------------------------------------
V1_NOT_COUNTIES = [
    "Grand Total, Full-Year Resident", "Residence Unknown ++", "NYS Unclassified +", "All Places",
]
V2_NOT_COUNTIES = [
    "All New York City", "Other Places- NYS Resident",
    "All Counties Outside of New York City", "All Places",
]
STATE_TOTAL_COUNTIES = ["Grand Total, Full-Year Resident", "All"]

# Adjusted gross income (thousands) of the one Hamilton row that really is Greene county.
MISLABELLED_HAMILTON_AGI_K = 802099

# --- states reported on their own -------------------------------------------------------------
NEIGHBOURS = ["Connecticut", "New Jersey", "Pennsylvania", "Florida", "Massachusetts"]
LEGACY_STATES = ["Connecticut", "New Jersey", "New York", "Pennsylvania"]
NOT_CONTIGUOUS = ["Alaska", "Hawaii"]

# --- thirteen raw income classes and the six ordered groups they fold into ----------------------
INCOME_GROUPS = [
    ("Less than $30,000", ["Under 5,000", "5,000 - 9,999", "10,000 - 19,999", "20,000 - 29,999"]),
    ("$30,000- $59,999", ["30,000 - 39,999", "40,000 - 49,999", "50,000 - 59,999"]),
    ("$60,000- $99,999", ["60,000 - 74,999", "75,000 - 99,999"]),
    ("100,000- 199,999", ["100,000 - 199,999"]),
    ("$200,000- $499,999", ["200,000 - 249,999", "250,000 - 499,999"]),
    ("$500,000 and over", ["500,000 and over"]),
]

# --- taxable sales ----------------------------------------------------------------------------
SALES_ROLLUPS = ["Mctd", "Ny State", "Ny City"]
WAYFAIR_JURISDICTIONS = ["ALBANY", "ERIE", "MONROE", "ONONDAGA", "ORANGE"]
WAYFAIR_INDUSTRIES = ["4541", "4522"]

MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# --- the fifty states with their geographic centres (longitude, latitude) -----------------------
# Alaska and Hawaii carry the conventional off-coast positions used for small-scale maps.
STATE_CENTERS = [
    ("Alabama", -86.7509, 32.5901), ("Alaska", -127.25, 49.25), ("Arizona", -111.625, 34.2192),
    ("Arkansas", -92.2992, 34.7336), ("California", -119.773, 36.5341),
    ("Colorado", -105.513, 38.6777), ("Connecticut", -72.3573, 41.5928),
    ("Delaware", -74.9841, 38.6777), ("Florida", -81.685, 27.8744), ("Georgia", -83.3736, 32.3329),
    ("Hawaii", -126.25, 31.75), ("Idaho", -113.93, 43.5648), ("Illinois", -89.3776, 40.0495),
    ("Indiana", -86.0808, 40.0495), ("Iowa", -93.3714, 41.9358), ("Kansas", -98.1156, 38.4204),
    ("Kentucky", -84.7674, 37.3915), ("Louisiana", -92.2724, 30.6181),
    ("Maine", -68.9801, 45.6226), ("Maryland", -76.6459, 39.2778),
    ("Massachusetts", -71.58, 42.3645), ("Michigan", -84.687, 43.1361),
    ("Minnesota", -94.6043, 46.3943), ("Mississippi", -89.8065, 32.6758),
    ("Missouri", -92.5137, 38.3347), ("Montana", -109.32, 46.823),
    ("Nebraska", -99.5898, 41.3356), ("Nevada", -116.851, 39.1063),
    ("New Hampshire", -71.3924, 43.3934), ("New Jersey", -74.2336, 39.9637),
    ("New Mexico", -105.942, 34.4764), ("New York", -75.1449, 43.1361),
    ("North Carolina", -78.4686, 35.4195), ("North Dakota", -100.099, 47.2517),
    ("Ohio", -82.5963, 40.221), ("Oklahoma", -97.1239, 35.5053), ("Oregon", -120.068, 43.9078),
    ("Pennsylvania", -77.45, 40.9069), ("Rhode Island", -71.1244, 41.5928),
    ("South Carolina", -80.5056, 33.619), ("South Dakota", -99.7238, 44.3365),
    ("Tennessee", -86.456, 35.6767), ("Texas", -98.7857, 31.3897), ("Utah", -111.33, 39.1063),
    ("Vermont", -72.545, 44.2508), ("Virginia", -78.2005, 37.563),
    ("Washington", -119.746, 47.4231), ("West Virginia", -80.6665, 38.4204),
    ("Wisconsin", -89.9941, 44.5937), ("Wyoming", -107.256, 43.0504),
]
STATE_NAMES = [name for name, _, _ in STATE_CENTERS]
