"""Reading and writing of panels, versions, models, results and external series."""
