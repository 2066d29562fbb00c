"""Relations over the tables on disk, registered queries and their SQL."""
