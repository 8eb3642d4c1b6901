"""Tables in and out: carriers over the driver tables, side tables of bodies, upserts and exports."""
