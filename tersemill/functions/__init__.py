"""Part of tersemill."""
