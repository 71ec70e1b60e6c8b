"""Reading, flattening, staging, sizing and publishing event data."""
