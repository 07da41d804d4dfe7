"""Named queries of the core and the SQL that checks them."""
