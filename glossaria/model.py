"""Names of the data model and the shapes of its tables."""

from __future__ import annotations

# Predicates, selectors and type names (fixed values).
ENUM_OF = "_predicate_enum-of"
FIELD_OF = "_predicate_field-of"
PROPERTY_OF = "_predicate_property-of"
SECTION_OF = "_predicate_section-of"
BRIDGE_OF = "_predicate_bridge-of"
REQUIRES_INDICATOR = "_predicate_requires_indicator"
REQUIRES_METADATA = "_predicate_requires_metadata"
LANGUAGE = "iso_639_3_eng"
DEFAULT_NAMESPACE = ";"
COLLECTIONS = ("terms", "edges", "links")
INFO_FIELDS = ("_title", "_definition", "_description", "_examples", "_notes")
CONTAINERS = ("_scalar", "_array", "_set", "_tuple", "_dict")
RANGES = {
    "num": ("_valid-range", ""),
    "str": ("_valid-range_string", "_string"),
    "date": ("_valid-range_date", "_date"),
}
BOUNDS = {"min_inc": "_min-range-inclusive", "min_exc": "_min-range-exclusive", "max_inc": "_max-range-inclusive", "max_exc": "_max-range-exclusive"}
SELECTORS = {
    "one": "_selection-descriptors_one",
    "one_none": "_selection-descriptors_one-none",
    "any": "_selection-descriptors_any",
    "one_none_of": "_selection-descriptors_one-none-of",
    "all": "_selection-descriptors_all",
}

#: Status codes of the validator (fixed values).
STATUS = {
    -7: "kINVALID_DICT_VALUE_SECTION",
    -6: "kINVALID_DICT_KEY_SECTION",
    -5: "kMISSING_DICT_VALUE_SECTION",
    -4: "kMISSING_DICT_KEY_SECTION",
    -3: "kMISSING_SET_SCALAR",
    -2: "kMISSING_DATA_TYPE",
    -1: "kEXPECTING_DATA_DIMENSION",
    0: "kOK",
    1: "kMODIFIED_VALUE",
    2: "kNOT_AN_ARRAY",
    3: "kEMPTY_OBJECT",
    4: "kUNKNOWN_TERM",
    5: "kNOT_A_DESCRIPTOR",
    6: "kNOT_A_SCALAR",
    8: "kNOT_A_BOOLEAN",
    9: "kNOT_AN_INTEGER",
    10: "kNOT_A_NUMBER",
    11: "kVALUE_OUT_OF_RANGE",
    12: "kVALUE_LOW_RANGE",
    13: "kVALUE_HIGH_RANGE",
    14: "kVALUE_NOT_A_TIMESTAMP",
    15: "kUNSUPPORTED_DATA_TYPE",
    16: "kNOT_A_STRING",
    17: "kNO_MATCH_REGEXP",
    18: "kEMPTY_KEY",
    19: "kNOT_AN_ENUM",
    20: "kNOT_A_STRUCTURE_DEFINITION",
    21: "kNO_REF_DEFAULT_NAMESPACE_KEY",
    22: "kUNKNOWN_DOCUMENT",
    23: "kBAD_KEY_VALUE",
    24: "kBAD_HANDLE_VALUE",
    25: "kBAD_COLLECTION_NAME",
    26: "kUNKNOWN_COLLECTION",
    27: "kNOT_CORRECT_ENUM_TYPE",
    28: "kUNKNOWN_DESCRIPTOR",
    29: "kPROPERTY_NOT_DESCRIPTOR",
    30: "kVALUE_NOT_TERM",
    31: "kNOT_AN_OBJECT",
    32: "kUNKNOWN_PROPERTY",
    33: "kINVALID_DATE_FORMAT",
    34: "kINVALID_OBJECT_STRUCTURE",
    35: "kVALUE_NOT_AN_ARRAY",
    36: "kARRAY_HAS_TOO_FEW_ELEMENTS",
    37: "kARRAY_HAS_TOO_MANY_ELEMENTS",
    38: "kGEOJSON_MISSING_TYPE",
    39: "kGEOJSON_MISSING_COORDINATES",
    40: "kGEOJSON_INVALID_COORDINATES",
    41: "kNO_REFERENCE_DEFAULT_NAMESPACE",
    42: "kNO_REFERENCE_DEFAULT_LANGUAGE",
    43: "kBAD_EDGE_KEY",
    44: "kVALUE_NOT_A_TUPLE_ARRAY",
    45: "kTUPLE_HAS_TOO_FEW_ELEMENTS",
    46: "kTUPLE_HAS_TOO_MANY_ELEMENTS",
    47: "kTUPLE_TYPES_NOT_ARRAY",
    48: "kTUPLE_MISSING_TYPES",
    49: "kTUPLE_FIXED_ELEMENTS",
    50: "kTUPLE_MIN_ELEMENTS_OVERFLOW",
    51: "kTUPLE_MAXELEMENTS_OVERFLOW",
    52: "kELEMENTS_COUNT_NOT_OBJECT",
    53: "kNESTED_BEYOND_LEVELS",  # not the reference's: the elements were not validated
}

CODE = "_code STRUCT<_nid: STRING, _lid: STRING, _gid: STRING, _aid: ARRAY<STRING>, _pid: ARRAY<STRING>, _name: STRING>"
INFO = "_info STRUCT<" + ", ".join(f"{f}: MAP<STRING, STRING>" for f in INFO_FIELDS) + ", _provider: STRING>"
TERMS = f"_key STRING, {CODE}, {INFO}, _data VARIANT, _rule VARIANT"
EDGES = "edge_key STRING, `from` STRING, predicate STRING, `to` STRING, roots ARRAY<STRING>, data MAP<STRING, STRING>"
LINKS = "edge_key STRING, `from` STRING, predicate STRING, `to` STRING, data MAP<STRING, STRING>"
