"""Event datasets in and out: discovery, schema checks, conversion, subsets."""
