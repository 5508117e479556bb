"""factloom: fact extraction, wiki text ETL and corpus statistics as DataFrame functions on PySpark."""
