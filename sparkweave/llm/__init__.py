"""Training-data operators: tokenising, filtering, mixing, de-duplication and scans.

Nothing outside this subpackage imports it; the registry adds its queries only
where it can be imported.
"""
