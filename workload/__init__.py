"""The registered queries, their input views and their reference SQL."""
