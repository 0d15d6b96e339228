"""Source trees and stored facts as DataFrames."""
