"""Named queries over the standard tables and the SQL that each is held against."""
