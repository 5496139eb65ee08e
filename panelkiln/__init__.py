"""panelkiln: lazy DataFrame-to-DataFrame operators for entity x period panels on Spark."""
