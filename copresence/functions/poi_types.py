"""Place types of point-of-interest tags."""

# fixed values: place type by tag; (a) marks amenities and (s) shops
POI_TYPES = {
    "Artisan Workshops": "Recreation",
    "Automotive Services (a)": "Mobility",
    "Automotive Services (s)": "Mobility",
    "Craft": "Retail",
    "Education (a)": "Education",
    "Education (s)": "Education",
    "Entertainment (s)": "Recreation",
    "Fashion and Accessories (s)": "Retail",
    "Financial Services (a)": "Financial",
    "Financial Services (s)": "Financial",
    "Food and Drink (a)": "Food, Drink, and Groceries",
    "Food and Drink (s)": "Food, Drink, and Groceries",
    "Groceries and Food (a)": "Food, Drink, and Groceries",
    "Groceries and Food (s)": "Food, Drink, and Groceries",
    "Health and Beauty (a)": "Health and Wellness",
    "Health and Beauty (s)": "Health and Wellness",
    "Healthcare (a)": "Health and Wellness",
    "Healthcare (s)": "Health and Wellness",
    "Home and Living": "Retail",
    "Leisure": "Recreation",
    "Office": "Office",
    "Office (s)": "Office",
    "Outdoor Recreation (a)": "Recreation",
    "Outdoor Recreation (s)": "Recreation",
    "Recreation (a)": "Recreation",
    "Recreation (s)": "Recreation",
    "Religious Places (a)": "Religious",
    "Shop": "Retail",
    "Sports and Activities (a)": "Recreation",
    "Sports and Activities (s)": "Recreation",
    "Tourism": "Recreation",
    "Transportation (a)": "Mobility",
    "Transportation (s)": "Mobility",
}
SMALL_TYPES = ("Financial", "Office", "Religious")


def merged_types() -> dict[str, str]:
    """The shorter list: the small types become 'Other'."""
    return {tag: "Other" if kind in SMALL_TYPES else kind for tag, kind in POI_TYPES.items()}
